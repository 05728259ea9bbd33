"""Fixed values.

Every list, table, pattern and constant in this module is part of the data
contract: results are only right when the values are exactly these. They are
kept together here, in their natural order, and hold no logic.
"""

# --- fixed values: enumerations -------------------------------------------
RUN_STATUSES = [
    "CREATED", "QUEUED", "RUNNING", "INTERRUPTED",
    "COMPLETED", "PARTIAL", "FAILED", "CANCELLED",
]
SOURCE_TYPES = ["GOOGLE", "PLATFORM", "WEBSITE"]
EXTRACTION_STATUSES = ["SUCCESS", "FAILED", "PARTIAL", "SKIPPED", "EXTRACTION_FAILED"]
FIELD_STATUSES = ["FOUND", "MISSING", "INVALID", "NOT_REQUESTED", "NOT_AVAILABLE"]
BUSINESS_STATUSES = ["VALID", "INVALID"]
AVAILABILITY_STATUSES = [
    "NOT_CHECKED", "NOT_SUPPORTED", "NOT_FOUND", "FOUND_NOT_BOOKABLE", "BOOKABLE",
    "NO_SLOTS", "TEMPORARILY_UNAVAILABLE", "BLOCKED", "FAILED",
]
FAILURE_CODES = [
    "BROWSER_START_FAILED", "NAVIGATION_FAILED", "CONSENT_FAILED", "FEED_NOT_FOUND",
    "CARD_PARSE_FAILED", "FIELD_EXTRACTION_FAILED", "VALIDATION_FAILED",
    "DATABASE_WRITE_FAILED", "DUPLICATE_RECORD", "CANCELLED_BY_USER",
    "RUN_INTERRUPTED", "UNKNOWN_ERROR",
]

# --- fixed values: allowed run status changes -----------------------------
STATUS_CHANGES = [
    ("CREATED", "QUEUED"), ("CREATED", "RUNNING"), ("CREATED", "CANCELLED"),
    ("QUEUED", "RUNNING"), ("QUEUED", "CANCELLED"), ("QUEUED", "INTERRUPTED"),
    ("RUNNING", "INTERRUPTED"), ("RUNNING", "COMPLETED"), ("RUNNING", "PARTIAL"),
    ("RUNNING", "FAILED"), ("RUNNING", "CANCELLED"),
    ("INTERRUPTED", "QUEUED"), ("INTERRUPTED", "RUNNING"), ("INTERRUPTED", "CANCELLED"),
    ("FAILED", "QUEUED"), ("FAILED", "RUNNING"),
    ("CANCELLED", "QUEUED"), ("CANCELLED", "RUNNING"),
    ("PARTIAL", "QUEUED"), ("PARTIAL", "RUNNING"),
]
ACTIVE_STATUSES = ["RUNNING", "QUEUED"]
RESUMABLE_STATUSES = ["INTERRUPTED", "FAILED", "CANCELLED", "CREATED"]
UNCANCELLABLE_STATUSES = ["COMPLETED", "FAILED", "CANCELLED"]
CONSOLE_TERMINAL_STATUSES = ["COMPLETED", "PARTIAL", "FAILED", "CANCELLED"]
STALE_MESSAGE = (
    "Execution was interrupted by process restart. "
    "Ready to resume from SQLite checkpoint."
)

# --- fixed values: legal suffixes, in the order they are tried -------------
LEGAL_SUFFIXES = [
    "pvt ltd", "private limited", "pvt. ltd.", "llp", "ltd", "limited", "inc",
    "inc.", "corp", "corporation", "co", "co.", "company",
]

# --- fixed values: Indian numbering plan -----------------------------------
PHONE_LABEL = r"(?i)^(phone|tel|contact|mobile|call)[\s:]*"
PHONE_NATIONAL = r"^(?:(?:000800|[2-9][0-9]{2})[0-9]{7}|1[0-9]{7,12})$"
# country codes in use, at the beginning of an international number
PHONE_COUNTRY = (
    r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|2[2-4]\d|25[0-8]|26\d|29[01789]|35\d|37[0-8]"
    r"|38[0-35-79]|42[013]|50\d|59\d|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[08]|88[0-368]|96[0-8]|97[0-79]|99[2-68])"
)
PHONE_MIN_DIGITS = 6
PHONE_MAX_DIGITS = 13
KEYPAD_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEYPAD_DIGITS = "22233344455566677778889999"

# --- fixed values: web addresses -------------------------------------------
TRACKING_PARAMETER = r"^(?:utm_.*|gclid|fbclid)$"
DOMAIN_ENDING = r"\.[a-zA-Z]{2,}$"

# --- fixed values: Indian states, tried in this order -----------------------
STATES = [
    ("andhra pradesh", "Andhra Pradesh"), ("arunachal pradesh", "Arunachal Pradesh"),
    ("assam", "Assam"), ("bihar", "Bihar"), ("chhattisgarh", "Chhattisgarh"),
    ("goa", "Goa"), ("gujarat", "Gujarat"), ("haryana", "Haryana"),
    ("himachal pradesh", "Himachal Pradesh"), ("jharkhand", "Jharkhand"),
    ("karnataka", "Karnataka"), ("kerala", "Kerala"),
    ("madhya pradesh", "Madhya Pradesh"), ("maharashtra", "Maharashtra"),
    ("manipur", "Manipur"), ("meghalaya", "Meghalaya"), ("mizoram", "Mizoram"),
    ("nagaland", "Nagaland"), ("odisha", "Odisha"), ("punjab", "Punjab"),
    ("rajasthan", "Rajasthan"), ("sikkim", "Sikkim"), ("tamil nadu", "Tamil Nadu"),
    ("telangana", "Telangana"), ("tripura", "Tripura"),
    ("uttar pradesh", "Uttar Pradesh"), ("uttarakhand", "Uttarakhand"),
    ("west bengal", "West Bengal"), ("delhi", "Delhi"), ("chandigarh", "Chandigarh"),
    ("puducherry", "Puducherry"), ("jammu and kashmir", "Jammu and Kashmir"),
    ("ladakh", "Ladakh"), ("mh", "Maharashtra"), ("dl", "Delhi"), ("ka", "Karnataka"),
    ("tn", "Tamil Nadu"), ("wb", "West Bengal"), ("up", "Uttar Pradesh"),
    ("gj", "Gujarat"), ("rj", "Rajasthan"), ("ts", "Telangana"),
    ("ap", "Andhra Pradesh"),
]

# --- fixed values: city catalog ---------------------------------------------
CITIES = [
    "mumbai", "delhi", "new delhi", "bengaluru", "bangalore", "hyderabad", "chennai",
    "kolkata", "pune", "ahmedabad", "jaipur", "surat", "lucknow", "kanpur", "nagpur",
    "indore", "thane", "bhopal", "visakhapatnam", "vadodara", "ghaziabad", "ludhiana",
    "agra", "nashik", "faridabad", "meerut", "rajkot", "varanasi", "srinagar",
    "aurangabad", "dhanbad", "amritsar", "navi mumbai", "allahabad", "prayagraj",
    "howrah", "ranchi", "gwalior", "jabalpur", "coimbatore", "vijayawada", "jodhpur",
    "madurai", "raipur", "kota", "chandigarh", "guwahati", "solapur", "hubli",
    "dharwad", "bareilly", "moradabad", "mysore", "gurugram", "gurgaon", "noida",
    "aligarh", "jalandhar", "tiruchirappalli", "bhubaneswar", "salem", "warangal",
    "thiruvananthapuram", "kochi", "dehradun",
]

# --- fixed values: address words ---------------------------------------------
LOCALITY_WORDS = [
    "nagar", "colony", "layout", "enclave", "extension", "extn", "sector", "block",
    "phase", "ward", "mohalla", "bazaar", "market", "mandi", "chowk", "circle",
    "corner", "naka", "wadi", "pada", "gaon", "pur", "ganj", "peth", "kuppam",
    "halli", "cheri", "palli", "basti", "midc", "gidc", "kiadb", "estate",
    "industrial area", "tech park", "sez", "complex", "plaza", "heights", "tower",
    "towers", "bhavan", "bhawan", "east", "west", "north", "south", "central",
]
THOROUGHFARE_WORDS = [
    "road", "rd", "marg", "street", "st", "lane", "gali", "cross", "main road",
    "highway", "path", "flyover",
]
PREMISE_WORDS = [
    "shop", "flat", "building", "bldg", "plot", "floor", "complex", "plaza", r"no\.",
]
NOT_A_CITY_WORDS = ["road", "marg", "lane", "street", "shop"]
ADDRESS_LABEL = r"(?i)^(address|addr|loc|location)[\s:]*"
PIN_CODE = r"\b([1-9][0-9]{5})\b"
ADDRESS_BREAK = r"[,\n|;]|(?:\s+[-–—]\s+)"
COUNTRY_NAME = "India"
COUNTRY_WORDS = ["india", "bharat"]

# --- fixed values: listing links ----------------------------------------------
PLACE_ID_PATTERNS = [
    r"19s(ChIJ[\w-]+)",
    r"[?&]place_id=([a-zA-Z0-9_-]+)",
    r"[?&]ftid=([0-9a-zA-Z_:-]+)",
    r"1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)",
]
PLACE_SLUG = r"/maps/place/([^/@?]+)"
PLACE_SLUG_LENGTH = 40
PIN_COORDINATES = r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)"
AT_COORDINATES = r"@(-?\d+\.\d+),(-?\d+\.\d+)"

# --- fixed values: card lines ---------------------------------------------------
CARD_RATING = (
    r"\b([1-5]\.\d)\b(?:\s*[\*★☆]|\s*stars)?"
    r"(?:\s*\(([0-9,]+)\)|(?:\s+([0-9,]+)\s*reviews?))?"
)
CARD_HOURS = r"\b(open|closed|closes|opens)\b"
CARD_PHONE = (
    r"(?:\+91[\s-]?|0)[6-9]\d{4}[\s-]?\d{5}\b"
    r"|[6-9]\d{4}[\s-]?\d{5}\b"
    r"|\b0\d{2,4}[-\s]?(?:\d{3,4}[-\s]?\d{3,4}|\d{6,8})\b"
)
CARD_SEPARATOR = r"[·•|]"
CARD_PRICE = r"^[$₹€£]+$"
CARD_NOT_CATEGORY = r"\b(open|closed|stars?|\d+\.\d+)\b"
CARD_ADDRESS_CUE = (
    r"\b(road|rd|marg|street|st|lane|gali|nagar|sector|block|floor|complex|plaza"
    r"|near|opp|behind|chowk)\b"
)
TEXT_ADDRESS_CUE = (
    r"\b(road|rd|marg|street|nagar|floor|complex|plaza|near|opp|behind|sector|block)\b"
)
TEXT_MOBILE = r"(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}\b"
TEXT_LANDLINE = r"\b0\d{2,4}[-\s]?\d{6,8}\b"
TEXT_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
# longest address that can be delivered to, by the mail standard
EMAIL_MAX_LENGTH = 254
LABEL_RATING = r"(\d+\.\d+)"
LABEL_REVIEWS = r"([\d,]+)\s+reviews?"
OWN_HOSTS = ["google.com", "gstatic.com"]
OWN_ANCHOR_HOSTS = ["google.com", "gstatic.com", "googleadservices"]

# --- fixed values: validation messages -------------------------------------------
NAME_MISSING = "Business name is missing or empty"
NAME_EMPTY = "Normalized business name is empty"
EXTRACTION_ERROR_UNKNOWN = "Unknown scraper error"
REQUEST_ERRORS = [
    "City must not be empty.",
    "Category must not be empty.",
    "Limit must be greater than 0.",
    "Limit must be less than or equal to 1000.",
    "Confidence threshold must be between 0.0 and 1.0.",
]
MAX_REQUESTED_LIMIT = 1000

# --- fixed values: provenance (field, method, confidence, rule) --------------------
DEFAULT_RULE = "mandatory_non_empty"
PROVENANCE = [
    ("google_place_id", "url_identifier_extraction", 1.00, "google_place_id_regex"),
    ("name", "title_dom_selector", 0.95, "min_length_2"),
    ("normalized_name", "deterministic_normalization", 0.95, "nfkd_ascii_strip_suffixes"),
    ("category", "category_button_extraction", 0.85, DEFAULT_RULE),
    ("address", "address_dom_extraction", 0.80, DEFAULT_RULE),
    ("street", "address_heuristics_parsing", 0.75, "thoroughfare_or_premise_token"),
    ("locality", "address_heuristics_parsing", 0.75, "generic_locality_token"),
    ("postal_code", "pin_regex_validation", 0.90, "indian_pin_6_digits"),
    ("state", "state_dictionary_matching", 0.90, "indian_state_canonical_dict"),
    ("phone", "phone_dom_extraction", 0.85, DEFAULT_RULE),
    ("normalized_phone", "phone_normalization_e164", 0.95, "phonenumbers_e164_in"),
    ("website", "authority_link_extraction", 0.85, DEFAULT_RULE),
    ("website_domain", "url_domain_canonicalization", 0.90, "urlparse_strip_www"),
    ("coordinates", "coordinate_url_parsing", 0.90, "wgs84_bounds_check"),
    ("rating", "rating_metric_extraction", 0.90, "float_0_to_5"),
    ("review_count", "reviews_metric_extraction", 0.90, "positive_int"),
]

# --- fixed values: browsing -----------------------------------------------------------
SORT_COLUMNS = [
    "created_at", "name", "rating", "review_count", "city", "category", "updated_at",
]

# --- fixed values: matching -------------------------------------------------------------
MATCH_WEIGHTS = {
    "phone": 25.0, "domain": 20.0, "name": 20.0, "address": 20.0,
    "city": 5.0, "category": 5.0, "social": 5.0,
}
MATCH_THRESHOLD = 80.0
AMBIGUITY_MARGIN = 5.0
STREET_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ln": "lane", "ave": "avenue", "apt": "apartment",
    "bldg": "building", "fl": "floor", "n": "north", "s": "south", "e": "east",
    "w": "west", "mg": "mahatma gandhi",
}
CATEGORY_SYNONYMS = {
    "hair salon": "hair salon", "hairdresser": "hair salon", "hair studio": "hair salon",
    "salon": "hair salon", "spa": "spa", "day spa": "spa", "nail salon": "nail salon",
    "car repair": "car repair", "garage": "car repair", "car garage": "car garage",
    "car dealer": "car dealer", "tyre shop": "tyre shop",
}

# --- fixed values: enrichment --------------------------------------------------------------
CRAWL_PAGES = {
    "phone": ["homepage", "contact", "about"],
    "email": ["homepage", "contact", "about"],
    "instagram": ["homepage", "footer", "contact", "about"],
    "facebook": ["homepage", "footer", "contact"],
    "linkedin": ["homepage", "footer", "about"],
    "whatsapp": ["homepage", "contact", "whatsapp_links"],
    "other_social": ["homepage", "footer", "contact", "about"],
}
CRAWL_PAGE_ORDER = ["homepage", "footer", "contact", "about", "whatsapp_links"]
MAX_PAGES_PER_BUSINESS = 5
SOCIAL_HOSTS = {
    "instagram": ["instagram.com"],
    "facebook": ["facebook.com", "fb.com"],
    "linkedin": ["linkedin.com"],
    "youtube": ["youtube.com"],
    "x": ["x.com", "twitter.com"],
    "whatsapp": ["wa.me", "whatsapp.com"],
    "tiktok": ["tiktok.com"],
}
SOURCE_PRIORITY = {
    "phone": ["google", "website", "platform"],
    "email": ["website", "platform", "other"],
    "instagram": ["website", "platform", "other"],
    "address": ["google", "platform"],
    "website": ["google", "platform"],
}
