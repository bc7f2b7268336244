"""Lexicons and scoring constants.

Words, names and numbers here are fixed values: scores depend on each of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Words of administration, which neither an address nor a result's name needs.
RESULT_STOPWORDS = frozenset("""
commonwealth district federation kingdom municipality prefecture province region republic state territory
""".split())
# Other words that say nothing of the place in an address.
ADDRESS_STOPWORDS = RESULT_STOPWORDS | frozenset("""
a above across address adj adjacent airport alley along aly an and apartment apt area at attention attn ave
avenue back bazaar behind below beside between bldg blk block blue blvd borough boulevard box brand bridge
building by cabinet cafe camp cantonment care center central centre chowk church cir circle city close co code
college colony commercial complex corner cottage country county court cres crescent cross crossing ct dam div
division do doorno dr drive enclave estate estates ext extension flat floor for fort from front furniture
gallery garden gardens gpo greater green hamlet here highway hno hospital hotel house hwy i in industrial
inner institute into is island it its junction lab lane layout live ln locality location lower mailbox main
mall marg market metro mosque nagar near new next no num number of ofc office old on opp opposite or outer
outlet park parkway path phase pin pincode pkwy pl place plot po pob port postal postbox ran rd red rent
residence residential restaurant rm road room route sandwich school sec sector shoes shop so society square st
station ste store street studio suburban suite temple ter terrace that the there this to tower town township
trail trl unit university upper villa village ward way white wing with wo zip zipcode zone
""".split())
# Inputs that stand for nothing.
GARBAGE = frozenset("""
- -- --- . .. ... 0 00 000 aaa abc dummy example n.a n.a. n/a na nil nill none null pending sample tba tbd
test testing undefined unknown unspecified xxx zzz
""".split())
# Fixed values.
DIRECTIONS = frozenset("""
central east eastern lower north northeast northern northwest south southeast southern southwest upper west
western
""".split())
# Place names that are common words too.
COLLISIONS = frozenset("""
alpine aurora bath berlin cambridge carolina chad chile china cleveland cork cuba dakota dover durham essen
florence georgia guinea hull jackson jordan lima lincoln madison mars mobile montana nice norman oakland
orange oxford paris pearl peru phoenix portland reading riverside salem split spring springs temple troy
turkey victoria virginia
""".split())
# Fixed values.
ADMIN_WORDS = frozenset("commonwealth federation kingdom prefecture province republic state territory".split())
CONNECTORS = frozenset("al and el of the".split())
# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "al": ["alabama"],
    "az": ["arizona"],
    "bih": ["bosnia and herzegovina"],
    "bkk": ["bangkok"],
    "ca": ["california", "canada"],
    "co": ["colorado"],
    "ct": ["connecticut"],
    "cz": ["czech republic"],
    "dc": ["district of columbia"],
    "dprk": ["north korea"],
    "drc": ["democratic republic of the congo"],
    "e": ["east"],
    "fl": ["florida"],
    "ga": ["georgia"],
    "hk": ["hong kong"],
    "il": ["illinois"],
    "jfk": ["new york"],
    "ksa": ["saudi arabia"],
    "la": ["louisiana", "los angeles"],
    "lhr": ["london"],
    "ma": ["massachusetts"],
    "md": ["maryland"],
    "mn": ["minnesota"],
    "mo": ["missouri"],
    "ms": ["mississippi"],
    "n": ["north"],
    "nc": ["north carolina"],
    "ne": ["northeast"],
    "nj": ["new jersey"],
    "nv": ["nevada"],
    "nw": ["northwest"],
    "ny": ["new york"],
    "nz": ["new zealand"],
    "oh": ["ohio"],
    "or": ["oregon"],
    "pa": ["pennsylvania"],
    "png": ["papua new guinea"],
    "prc": ["china"],
    "rok": ["south korea"],
    "rsa": ["south africa"],
    "s": ["south"],
    "sc": ["south carolina"],
    "se": ["southeast"],
    "sf": ["san francisco"],
    "sg": ["singapore"],
    "sk": ["slovakia"],
    "sw": ["southwest"],
    "tn": ["tennessee"],
    "tx": ["texas"],
    "uae": ["united arab emirates"],
    "uk": ["united kingdom"],
    "us": ["united states"],
    "usa": ["united states"],
    "ussr": ["soviet union"],
    "va": ["virginia"],
    "w": ["west"],
    "wa": ["washington", "western australia"],
    "wi": ["wisconsin"],
}
# Other names and the names that they stand for.
ALTERNATES = {
    "abyssinia": "ethiopia",
    "al-iraq": "iraq",
    "al-jazair": "algeria",
    "al-qahira": "cairo",
    "al-riyadh": "riyadh",
    "alba": "scotland",
    "alemania": "germany",
    "allemagne": "germany",
    "aotearoa": "new zealand",
    "athenes": "athens",
    "athina": "athens",
    "bayrut": "beirut",
    "belgie": "belgium",
    "belgique": "belgium",
    "beograd": "belgrade",
    "bharat": "india",
    "bombay": "mumbai",
    "brasil": "brazil",
    "bresil": "brazil",
    "brussel": "brussels",
    "bruxelles": "brussels",
    "bucuresti": "bucharest",
    "burma": "myanmar",
    "byzantium": "istanbul",
    "calcutta": "kolkata",
    "cesko": "czech republic",
    "chosen": "north korea",
    "constantinople": "istanbul",
    "copenhague": "copenhagen",
    "cymru": "wales",
    "czechia": "czech republic",
    "danmark": "denmark",
    "den haag": "the hague",
    "deutschland": "germany",
    "dimashq": "damascus",
    "east timor": "timor leste",
    "egypte": "egypt",
    "eiran": "iran",
    "eire": "ireland",
    "ellada": "greece",
    "espagne": "spain",
    "espana": "spain",
    "eyran": "iran",
    "filastin": "palestine",
    "formosa": "taiwan",
    "francia": "france",
    "frankreich": "france",
    "geneve": "geneva",
    "genf": "geneva",
    "germania": "germany",
    "hanguk": "south korea",
    "hayastan": "armenia",
    "hellas": "greece",
    "hindustan": "india",
    "holland": "netherlands",
    "hollande": "netherlands",
    "hongrie": "hungary",
    "hrvatska": "croatia",
    "italia": "italy",
    "italie": "italy",
    "joseon": "north korea",
    "kernow": "cornwall",
    "kobenhavn": "copenhagen",
    "koln": "cologne",
    "krung thep": "bangkok",
    "le caire": "cairo",
    "libye": "libya",
    "lisboa": "lisbon",
    "lisbonne": "lisbon",
    "lubnan": "lebanon",
    "madras": "chennai",
    "magyarorszag": "hungary",
    "maroc": "morocco",
    "masr": "egypt",
    "mexique": "mexico",
    "misr": "egypt",
    "moscou": "moscow",
    "moskva": "moscow",
    "munchen": "munich",
    "nederland": "netherlands",
    "nihon": "japan",
    "nippon": "japan",
    "norge": "norway",
    "osterreich": "austria",
    "peking": "beijing",
    "persia": "iran",
    "pologne": "poland",
    "polska": "poland",
    "prag": "prague",
    "praha": "prague",
    "rangoon": "yangon",
    "rhodesia": "zimbabwe",
    "roma": "rome",
    "romania": "romania",
    "rossiya": "russia",
    "roumanie": "romania",
    "russie": "russia",
    "saigon": "ho chi minh city",
    "sakartvelo": "georgia",
    "schweiz": "switzerland",
    "shqiperia": "albania",
    "siam": "thailand",
    "srbija": "serbia",
    "suisse": "switzerland",
    "suomi": "finland",
    "suriya": "syria",
    "sverige": "sweden",
    "svizzera": "switzerland",
    "timor leste": "timor leste",
    "tunisie": "tunisia",
    "turkiye": "turkey",
    "turquie": "turkey",
    "varsovie": "warsaw",
    "vienne": "vienna",
    "warszawa": "warsaw",
    "wien": "vienna",
    "yisrael": "israel",
    "zhongguo": "china",
    "zurich": "zurich",
}


@dataclass(frozen=True)
class Config:
    """Scores, caps and thresholds; every field takes effect. The lexicons can be replaced too."""

    # Fixed values.
    abbreviation: float = 0.88
    alternate: float = 0.82
    stem: float = 0.70
    phonetic: float = 0.72
    half_phonetic: float = 0.65
    reversed_order: float = 0.05
    gap: float = 0.30
    gap_most: float = 0.65
    direction_wrong: float = 0.15
    direction_missing: float = 0.90
    collision: float = 0.70
    inside_query: float = 0.65
    inside_query_edge_most: float = 0.58
    inside_query_middle_most: float = 0.45
    inside_result_most: float = 0.40
    inside_least: int = 4
    elevated_ratio: float = 0.55
    elevated_most: float = 0.85
    least_token: int = 2
    fuzzy: float = 0.82
    fuzzy_weight: float = 0.91
    edit_weights: dict = field(default_factory=lambda: {0: 1.0, 1: 0.88, 2: 0.75, 3: 0.55})
    edit_caps: dict = field(default_factory=lambda: {0: 0.95, 1: 0.90, 2: 0.82, 3: 0.75})
    compound: float = 0.85
    compound_fuzzy: float = 0.90
    connector: float = 0.05
    high: float = 0.75
    medium: float = 0.40
    commercial_words: frozenset = frozenset()
    address_stopwords: frozenset = ADDRESS_STOPWORDS
    result_stopwords: frozenset = RESULT_STOPWORDS
    garbage: frozenset = GARBAGE
    directions: frozenset = DIRECTIONS
    collisions: frozenset = COLLISIONS
    admin_words: frozenset = ADMIN_WORDS
    connectors: frozenset = CONNECTORS
    abbreviations: dict = field(default_factory=lambda: ABBREVIATIONS)
    alternates: dict = field(default_factory=lambda: ALTERNATES)


DEFAULT = Config()
