"""Word lists, tables and thresholds that decide results.

Every name here is data.  Results change when a value changes; nothing here is logic.
"""

# fixed values: measurement tolerances (inches, inches, litres)
TOL_WIDTH = "0.15"
TOL_THICKNESS = "0.08"
TOL_VOLUME = "0.75"

# fixed values: sixteenths in lowest terms
SIXTEENTHS = {
    "1/16": "0.0625", "1/8": "0.125", "3/16": "0.1875", "1/4": "0.25", "5/16": "0.3125",
    "3/8": "0.375", "7/16": "0.4375", "1/2": "0.5", "9/16": "0.5625", "5/8": "0.625",
    "11/16": "0.6875", "3/4": "0.75", "13/16": "0.8125", "7/8": "0.875", "15/16": "0.9375",
}

# fixed values: construction spellings used in matching
CONSTRUCTION_ALIASES = {
    "standard": "", "rt": "", "carbon tune": "carbotune", "hyfi 3": "hyfi", "hyfi 3 0": "hyfi",
    "i bolic": "ibolic", "i bolic 2 0": "ibolic", "pu stringer": "pu", "polyester": "pu",
    "spine tek": "spinetek", "ect carbon": "ectcarbon", "future flex": "futureflex",
    "black sheep": "blacksheep", "c1 carbon": "c1carbon", "e3 lite": "e3lite",
}

# fixed values: construction words recognised in titles
CONSTRUCTION_TITLE_TOKENS = {
    "carbotune": ("carbotune", "carbon tune"),
    "hyfi": ("hyfi", "hyfi 3", "hyfi 3.0"),
    "ibolic": ("ibolic", "i-bolic", "i bolic"),
    "pu": (" pu ", "polyester", "pu stringer"),
    "pe": (" pe ",),
    "eps": (" eps ",),
    "spinetek": ("spine-tek", "spine tek", "spinetek"),
    "ectcarbon": ("ect-carbon", "ect carbon"),
    "futureflex": ("futureflex", "future flex", "ff"),
    "helium": ("helium",),
    "blacksheep": ("black sheep",),
    "lightspeed": ("light speed", "lightspeed"),
    "c1carbon": ("c1carbon", "c1 carbon"),
    "e3lite": ("e3lite", "e3 lite"),
}

# fixed values: construction spellings used by the search policy
POLICY_CONSTRUCTION_ALIASES = {
    "hyfi": "hyfi 3 0", "hyfi 3": "hyfi 3 0", "hyfi 3 0": "hyfi 3 0", "carbotune": "carbotune", "carbon tune": "carbotune",
    "pu": "pu", "pe": "pe", "poly": "pu", "polyester": "pu", "eps": "eps", "ect": "ect carbon", "ect carbon": "ect carbon",
    "spine tek": "spine tek", "spinetek": "spine tek", "standard": "standard", "i bolic": "i bolic", "ibolic": "i bolic",
    "i bolic 2 0": "i bolic", "ibolic 2 0": "i bolic",
    "i bolic core with fiberglass lamination": "i bolic",
    "ibolic core with fiberglass lamination": "i bolic",
    "i bolic volcanic": "i bolic volcanic", "ibolic volcanic": "i bolic volcanic",
}

# fixed values: trailing words that do not tell model families apart
FAMILY_SUFFIXES = (
    "round", "squash", "swallow", "tail", "grom", "king", "fish", "long", "toe", "step", "up",
    "gun", "xl", "eps", "pu", "softboard", "soft", "futureflex", "futures", "fcs", "carbon", "wrap",
)

# fixed values: merchandising suffixes removed from a model key
KEY_COLOURS = (
    "white", "black", "blue", "navy", "red", "orange", "yellow", "green", "grey", "gray", "pink",
    "sand", "clear", "color", "colour", "new", "used", "in stock", "out of stock", "pre order",
)

# fixed values: colours removed from the end of a model hint
HINT_COLOURS = (
    "white", "black", "blue", "navy", "red", "orange", "yellow", "green", "grey", "gray", "pink",
    "sand", "coral", "mustard", "burgundy", "cream", "taupe", "olive", "mint", "clear", "color", "colour",
)

# fixed values: model spellings with one known meaning
MODEL_KEY_ALIASES = {
    "421": "421 fish", "fishbeard": "fish beard", "high line": "highline", "hk twin": "hk twin pin",
    "juliette": "ee juliette", "machado cado": "machadocado", "mav s gun": "mavs gun",
    "mikey febs fish": "feb s fish", "mini driver": "mini driver re issue",
    "mikey s shorty": "mikey february shorty", "california twin": "cali twin",
    "mickstape sym": "micks tape sym", "neck beard 2": "neckbeard 2", "sabo taj": "sabotaj",
    "spud nick": "spudnick", "sword fish": "swordfish", "sweetspot": "sweet spot 4",
    "water hog": "waterhog", "whitetiger": "white tiger", "hypto twin": "hypto krypto twin",
}

# fixed values: model names too general to trust alone
GENERIC_MODELS = (
    "fish", "log", "longboard", "mid", "mid length", "shortboard", "softboard", "twin", "twin fin",
)

# fixed values: stock texts that mean "available"
AVAILABLE_STATUSES = ("in stock", "instock", "in_stock", "available", "true")
SNAPSHOT_STATUSES = ("in stock", "instock", "available", "true")

# fixed values: listing classifier word lists
BOARD_TYPES = (
    "surfboard", "surfboards", "surf board", "surf boards", "shortboard", "shortboards", "longboard", "longboards",
    "mid length", "midlength", "step up", "step-up", "softboard", "softboards", "foamie", "foam board", "funboard",
    "fun board", "malibu", "mini mal", "mini-mal", "gun", "fish", "twin fin", "twinfin", "performance board",
    "performance boards", "hybrid board", "hybrid boards",
)
BOARD_CATEGORIES = (
    "surfboards", "surfboard", "surf-surfboards", "performance_boards", "performance boards", "fun_boards", "fun boards",
    "longboards", "shortboards", "softboards", "midlengths", "mid lengths",
)
LISTING_BRANDS = (
    "js", "js industries", "al merrick", "channel islands", "ci surfboards", "lost", "lost surfboards", "mayhem", "pyzel",
    "firewire", "slater designs", "dhd", "haydenshapes", "hayden shapes", "sharp eye", "sharpeye", "chilli", "rusty",
    "album", "christenson", "pukas", "torq", "softlite", "mick fanning", "mick fanning softboards", "nsp", "aloha", "misfit",
    "dms", "simon anderson", "chemistry", "mctavish", "thunderbolt", "takayama", "walden", "bennetts", "creative army",
    "modern", "superbrand", "stacey", "dhdsurf",
)
USED_TERMS = ("second", "second hand", "used", "pre loved", "pre-loved")
CONSTRUCTION_TERMS = (
    "hyfi", "hyfi 3.0", "spinetek", "helium", "lft", "timbertek", "thunderbolt", "futureflex", "dark arts", "carbotune", "pu",
    "poly", "eps", "epoxy", "pe", "carbon", "soft tech", "softtech", "ibolic", "volcanic",
)
FIN_SYSTEMS = (
    "futures", "fcs", "fcs ii", "fcs2", "single fin", "2 plus 1", "thruster", "quad", "twin", "five fin", "5 fin",
)
HARD_EXCLUDE_TERMS = (
    "boardshort", "board short", "brdshrt", "wetsuit", "spring suit", "springsuit", "steamer", "rash vest", "rashguard",
    "rash guard", "tee", "t-shirt", "shirt", "singlet", "hood", "hoodie", "fleece", "jumper", "jacket", "pants", "shorts",
    "dress", "bikini", "cap", "hat", "beanie", "sunscreen", "zinc", "wax", "comb", "legrope", "leg rope", "leash", "tail pad",
    "traction", "deck grip", "grip pad", "sticker", "towel", "poncho", "sock", "board sock", "cover", "stretch cover",
    "board cover", "board bag", "day bag", "travel bag", "coffin", "accessory", "accessories", "strap", "tie down",
    "roof rack", "wall rack", "board sling", "skate", "skateboard", "snowboard", "sunglasses", "watch", "gift card", "voucher",
    "repair kit", "ding repair", "ding all",
)
SERVICE_TERMS = (
    "board hire", "hire board", "hire boards", "surfboard hire", "board rental", "rental board", "rental boards",
    "surfboard rental", "surf lesson", "surf lessons", "lesson package", "lesson packages", "repair service",
    "repair services", "board repair", "board repairs", "surf trip", "surf trips", "trip package", "trip packages",
    "board storage", "storage locker",
)
FIN_ACCESSORY_TERMS = (
    "fins", "fin set", "keel fin", "thruster fin", "quad fin", "single fin", "centre fin", "center fin", "side fins",
    "replacement fin",
)

# fixed values: listing classifier patterns
LENGTH_RX = r"(?i)\b(?:[4-9]|1[0-2])\s*(?:'|’|ft)\s*\d{0,2}\b"
DECIMAL_LENGTH_RX = r"\b(?:[4-9]|1[0-2])\.(?:0|1|2|3|4|5|6|7|8|9|10|11|12)\b"
COMPACT_LENGTH_RX = r"\b(?:[4-9]|1[0-2])(?:0|1|2|3|4|5|6|7|8|9|10|11|12)\b"
FULL_DIMENSION_RX = (
    r"(?i)\b(?:[4-9]|1[0-2])\s*(?:'|’|ft)\s*\d{0,2}\s*(?:\"|in)?\s*[xX*]\s*"
    r"\d{1,2}(?:\s+\d{1,2}/\d{1,2})?(?:\.\d+)?\s*(?:\"|in)?\s*[xX*]\s*"
    r"\d(?:\s+\d{1,2}/\d{1,2})?(?:\.\d+)?"
)
LITRE_RX = r"(?i)\b(?:1[5-9]|[2-7]\d|8[0-5])(?:\.\d{1,2})?\s*(?:l|ltr|litre|litres)\b"
BOARD_URL_RX = r"(?i)(surfboard|surfboards|shortboard|longboard|midlength|mid-length|softboard|foamie)"

# fixed values: catalogue admission word lists
GUARD_HARD_NEGATIVE = (
    "art", "book", "ceramic", "event", "gift card", "jewellery", "jewelry", "poster", "pottery", "print", "sticker", "vase",
)
GUARD_SOFT_NEGATIVE = (
    "accessory", "apparel", "bag", "beanie", "cap", "fin", "fins", "hat", "hoodie", "leash", "merch", "shirt", "sunscreen",
    "tee", "towel", "traction", "wax",
)
GUARD_POSITIVE = (
    "surfboard", "surf board", "shortboard", "longboard", "midlength", "mid length", "mid-length", "fish", "twin fin",
    "step up", "gun", "groveler", "groveller", "single fin", "performance board", "board models", "step-up", "glider",
    "thruster", "quad", "keel", "rocker", "concave", "rail", "tail",
)
GUARD_URL_POSITIVE = ("/surfboards", "/boards", "/board-models")
GUARD_DIMENSION_RX = (
    r"(?i)\b([4-9]|1[0-1])\s*(?:'|’|ft)\s*\d{1,2}(?:\s*(?:\"|''))?\s*x\s*\d{1,2}(?:\s+\d/\d|(?:\.\d+)?)?"
    r"\s*x\s*\d(?:\s+\d/\d|(?:\.\d+)?)?"
)
GUARD_LENGTH_RX = r"(?i)\b([4-9]|1[0-1])\s*(?:'|’|ft)\s*\d{1,2}\b"
GUARD_VOLUME_RX = r"(?i)\b\d{1,2}(?:\.\d+)?\s*l(?:iters|itres)?\b"

# fixed values: products left out of link projections, first match decides
EXCLUDED_PRODUCTS = (
    ("used_board", r"\bused\b"), ("consignment_board", r"\bconsignment\b"), ("trade_in_board", r"\btrade[\s-]*in\b"),
    ("wall_art", r"\bwall art\b"), ("custom_deposit", r"\bcustom deposit\b"), ("kneeboard", r"\bkneeboard\b"),
)

# fixed values: words in image addresses that speak against and for a product photo, and title words without meaning
IMAGE_REJECT_TERMS = (
    "leash", "legrope", "leg-rope", "traction", "tail-pad", "tailpad", "grip", "wax", "fin", "fins", "cover", "bag", "sock",
    "strap", "tie-down", "wetsuit", "steamer", "rash", "oe-6ft-flex", "diamond-flex", "regular-diamond", "premium-one-xt",
)
IMAGE_PREFERRED_TERMS = (
    "monsta", "xero", "gravity", "fusion", "black-baron", "baron", "raging-bull", "bull", "blak-box", "air-17",
    "golden-child", "sub-xero", "surfboard", "board", "main",
)
IMAGE_TITLE_STOPS = ("the", "and", "with", "fcs", "fcsii", "fcs2", "pu", "eps")

# fixed values: regional listings, first pattern decides
REGIONAL_CONSTRUCTION_RX = (
    ("PU", r"(?i)(?<![a-z0-9])pu(?![a-z0-9])"),
    ("EPS", r"(?i)(?<![a-z0-9])eps(?![a-z0-9])"),
    ("Epoxy", r"(?i)(?<![a-z0-9])epoxy(?![a-z0-9])"),
    ("Carbon", r"(?i)(?<![a-z0-9])carbon(?![a-z0-9])"),
    ("Spine-Tek", r"(?i)spine\s*-?\s*tek"),
)
REGIONAL_FIN_RX = (
    ("FCS II", r"(?i)(?<![a-z0-9])fcs\s*(?:ii|2|ll)(?![a-z0-9])"),
    ("FCS", r"(?i)(?<![a-z0-9])fcs(?![a-z0-9])"),
    ("Futures", r"(?i)(?<![a-z0-9])futures?(?![a-z0-9])"),
    ("Twin", r"(?i)(?<![a-z0-9])twin(?:\s*fin)?(?![a-z0-9])"),
    ("Thruster", r"(?i)(?<![a-z0-9])(?:tri\s*fin|thruster)(?![a-z0-9])"),
    ("2 Fin", r"(?i)(?<![a-z0-9])2\s*fin(?![a-z0-9])"),
)
REGIONAL_LENGTH_RX = (
    r"\b([4-9]|1[0-2])\s*['’]\s*(\d{1,2})\s*(?:''|\"|”|in)?\b",
    r"(?i)\b([4-9]|1[0-2])\s*ft\s*(\d{1,2})\s*(?:\"|”|in)?\b",
    r"\b([4-9]|1[0-2])\.(\d{1,2})\b",
)
REGIONAL_VOLUME_RX = r"(?i)(?:\b(?:volume|vol\.?)\s*[:\-]?\s*)?\b((?:1[5-9]|[2-7]\d|8[0-5])(?:[\.,]\d{1,2})?)\s*(?:l|ltr|litre|litres)\b"
# fixed values: what is taken out of a title, one after the other, to leave the model
REGIONAL_RESIDUE_RX = (
    r"(?i)\bsurfboards?\b",
    r"(?i)\b(?:[4-9]|1[0-2])\s*['’]\s*\d{1,2}\s*(?:''|\"|”|in)?\b",
    REGIONAL_VOLUME_RX,
    r"(?i)\bpu\b|\beps\b|\bepoxy\b|\bcarbon\b|spine\s*-?\s*tek",
    r"(?i)\bfcs\s*(?:ii|2|ll)?\b|\bfutures?\b|\btwin(?:\s*fin)?\b|\btri\s*fin\b|\bthruster\b",
    r"(?i)\b(?:white|black|blue|red|orange|color|sand)\b",
)

# fixed values: words that betray an unclean model name, first match decides
PARSING_ISSUES = (
    ("construction_suffix", r"\b(?:pu|eps|hyfi|carbotune|futureflex|helium|ibolic|volcanic|easy rider|x series)\b"),
    ("colour_suffix", r"\b(?:white|black|blue|red|green|clear|sand|grey|gray)\b"),
    ("tail_or_fin_suffix", r"\b(?:squash|swallow|round pin|fcs|fcs 2|futures|thruster)\b"),
    ("size_left_in_model", r"\b[4-9]\s*(?:ft|feet)\s*\d+\b"),
)

# fixed values: signs that a hint is not a clean model name
HINT_LENGTH_RX = r"\b[4-9]\s*['’]\s*\d"
HINT_COLOUR_RX = r"\b(?:white|black|blue|red|orange|pink|sand|grey|gray|coral|mustard|burgundy|cream|taupe|olive|mint|colour|color)\b"
HINT_CONSTRUCTION_RX = r"\b(?:pu|eps|pe|tet|lct|futures|fcs|hyfi|helium|ibolic|volcanic|carbon wrap|spine tek|ecoskin|polish|\d+f)\b"
