"""Words, formats and tables that results must agree with."""

# -- property types: raw sub-type or type, lower case, by category ----------------------------------------------------
PROPERTY_TYPES = {
    "Apartment": ["flat", "residential flats", "residential", "unit", "studio", "penthouse"],
    "Villa": ["villa", "complex villas", "residential / residential villa", "residential / villas", "residential / attached villas", "arabian house"],
    "Townhouse": ["stacked townhouses"],
    "Office": ["office", "offices", "desk", "mezzanine", "commercial / offices / residential"],
    "Retail": ["shop", "shops", "showroom", "kiosk", "store", "supermarket", "shopping mall", "commercial", "restaurant"],
    "Hotel": ["hotel", "hotel apartment", "hotel apartments", "hotel rooms", "hotel building"],
    "Industrial": ["warehouse", "warehouse complex", "complex warehouse", "workshop", "factory", "industrial", "labor camps", "labor camp", "staff accommodation"],
    "Land": ["land", "open land", "open space", "land parking"],
    "Other": [
        "general use", "building", "government housing", "school", "college", "nursery", "clinic", "medical center", "health club", "gym", "sports club",
        "bank", "petrol station", "exhbition center", "hospital", "ladies saloon", "parking", "sized partition", "spa",
    ],
}
BEDROOMS = ["Studio", "1BR", "2BR", "3BR", "4BR", "5BR+", "Other", "Unknown"]
NO_BEDROOM = ["hotel", "office", "shop", "penthouse"]

# -- statuses: the first pattern found decides ------------------------------------------------------------------------
STATUS_PATTERNS = [
    ("cancelled", r"cancelled"),
    ("on_hold", r"on[\s-]?hold"),
    ("delayed", r"delayed"),
    ("completed", r"complete"),
    ("under_construction", r"under\s*development|under\s*construction|construction"),
    ("planned", r"planned|planning|design\s*stage"),
    ("announced", r"announced"),
]

# -- free text formats ------------------------------------------------------------------------------------------------
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
FILLER_WORDS = ["tower", "bldg", "building", "block", "ph", "phase"]
HYPHENS = [" - ", " – ", " — "]

# -- area names that are landmarks, lower case ------------------------------------------------------------------------
LANDMARKS = [
    "ski dubai", "skydive dubai", "madinat jumeirah complex", "the walk jbr", "dubai miracle garden", "grandiose supermarket sports city",
    "enoc station jvc", "sports city supermarket", "the springs souk", "the storm coaster",
]

# -- marks of pages that a site serves instead of content, lower case -------------------------------------------------
BLOCK_MARKS = [
    "checking your browser", "cf-browser-verification", "attention required! | cloudflare", "please verify you are a human", "complete the captcha",
    "solve the captcha", "captcha to continue", "access denied", "sorry, you have been blocked", "ray id",
]

# -- crawl scope ------------------------------------------------------------------------------------------------------
PATH_PREFIX = "/dubai/"
AREA_INDEX = "area-guides"
AREA_PAGES = ["buildings", "amenities", "schools", "things-to-do"]
EXCLUDED_PARTS = ["/properties-buy-rent", "/pro-tools", "/account/", "-pro-subscription"]
ASSETS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".css", ".js", ".ico", ".woff", ".woff2", ".ttf", ".mp4"]
