"""Lists, names and codes that results depend on."""

# --- fixed values -------------------------------------------------------------------------

LEVELS = ("WR", "CR", "NR", "PR")
CLAIM_LEVELS = ("WR", "CR", "NR")

SINGLE_EVENTS = (
    "222",
    "333",
    "444",
    "555",
    "666",
    "777",
    "333bf",
    "333fm",
    "333oh",
    "clock",
    "minx",
    "pyram",
    "skewb",
    "sq1",
    "444bf",
    "555bf",
    "333mbf",
    "333mbo",
    "333ft",
    "magic",
    "mmagic",
)
EVENTS_WITHOUT_AVERAGE = ("333mbf", "333mbo")
AVERAGE_EVENTS = tuple(e for e in SINGLE_EVENTS if e not in EVENTS_WITHOUT_AVERAGE)

EVENT_SHORT_NAMES = {
    "333": "3x3",
    "222": "2x2",
    "444": "4x4",
    "555": "5x5",
    "666": "6x6",
    "777": "7x7",
    "333bf": "3x3 BLD",
    "333fm": "3x3 FMC",
    "333oh": "3x3 OH",
    "clock": "Clock",
    "minx": "Megaminx",
    "pyram": "Pyraminx",
    "skewb": "Skewb",
    "sq1": "Square-1",
    "444bf": "4x4 BLD",
    "555bf": "5x5 BLD",
    "333mbf": "3x3 MBLD",
    "333mbo": "3x3 MBO",
    "333ft": "3x3 Feet",
    "magic": "Magic",
    "mmagic": "Master Magic",
}

EVENT_SEARCH_TERMS = {
    "222": ("small cubes", "nxnxn"),
    "333": ("small cubes", "nxnxn"),
    "444": ("big cubes", "nxnxn"),
    "555": ("big cubes", "nxnxn"),
    "666": ("big cubes", "nxnxn"),
    "777": ("big cubes", "nxnxn"),
    "333bf": ("blindfolded", "bld", "3x3 variants"),
    "444bf": ("blindfolded", "bld", "big blindfolded", "big bld"),
    "555bf": ("blindfolded", "bld", "big blindfolded", "big bld"),
    "333fm": ("3x3 variants",),
    "333oh": ("3x3 variants",),
    "333mbf": ("blindfolded", "bld", "3x3 variants"),
    "clock": ("side events",),
    "minx": ("side events",),
    "pyram": ("side events",),
    "skewb": ("side events",),
    "sq1": ("side events",),
    "333ft": ("dead events", "removed", "retired", "discontinued", "former"),
    "magic": ("dead events", "removed", "retired", "discontinued", "former"),
    "mmagic": ("dead events", "removed", "retired", "discontinued", "former"),
    "333mbo": ("blindfolded", "bld", "dead events", "removed", "retired", "discontinued", "former"),
}

CONTINENTS = ("Africa", "Asia", "Europe", "North America", "South America", "Oceania")
CONTINENT_LABELS = {
    "Africa": "AfR",
    "Asia": "AsR",
    "Europe": "ER",
    "North America": "NAR",
    "South America": "SAR",
    "Oceania": "OcR",
}
CONTINENTAL_TAGS = ("AFR", "ASR", "ER", "NAR", "OCR", "SAR")

COUNTRY_NAME_ALIASES = {
    "Bolivia": "BO",
    "Brunei": "BN",
    "Cape Verde": "CV",
    "China": "CN",
    "Chinese Taipei": "TW",
    "Congo": "CG",
    "Czech Republic": "CZ",
    "Democratic Republic of the Congo": "CD",
    "East Timor": "TL",
    "Hong Kong, China": "HK",
    "Iran": "IR",
    "Kosovo": "XK",
    "Laos": "LA",
    "Macau, China": "MO",
    "Moldova": "MD",
    "North Korea": "KP",
    "Palestine": "PS",
    "Republic of Korea": "KR",
    "Russia": "RU",
    "South Korea": "KR",
    "Syria": "SY",
    "Taiwan": "TW",
    "Tanzania": "TZ",
    "United Kingdom": "GB",
    "United States": "US",
    "Venezuela": "VE",
    "Vietnam": "VN",
}
PROVINCE_COUNTRIES = {"Hong Kong, China": "HK", "Macau, China": "MO", "Chinese Taipei": "TW"}
PROVINCE_DEFAULT = "CN"

# Ingestion methods, their rank as evidence, and the ones whose claims are trusted.
POLLED = "api_polling"
SUBSCRIBED = "graphql_subscription"
SOCKET = "cubingchina_websocket"
EVIDENCE_RANK = {POLLED: 100, SUBSCRIBED: 100, SOCKET: 20}
TRUSTED_METHODS = (POLLED, SUBSCRIBED)
SECOND_SOURCE = "cubingchina"
SECOND_SOURCE_LABEL = "CubingChina Live"
FIRST_SOURCE = "wca_live"
FIRST_SOURCE_LABEL = "WCA Live"

ALERT_TYPES = {"WR": "record_wr", "CR": "record_cr", "NR": "record_nr"}
DEFAULT_PREFERENCES = {"record_wr": True, "record_cr": True, "record_nr": True}
DELIVERY_STATUSES = (
    "pending",
    "processing",
    "sent",
    "retry",
    "permanently_failed",
    "cancelled",
)
OPEN_DELIVERY_STATUSES = ("pending", "retry", "processing")
RETRY_DELAYS_SECONDS = (60, 300, 1800, 7200)
MAX_DELIVERY_ATTEMPTS = 5

REQUIRED_EXPORT_COLUMNS = {
    "competitions": ("id", "end_year", "end_month", "end_day"),
    "continents": ("id", "name"),
    "countries": ("id", "name", "continent_id"),
    "persons": ("wca_id", "sub_id", "country_id"),
    "ranks_average": ("person_id", "event_id", "best"),
    "ranks_single": ("person_id", "event_id", "best"),
    "result_attempts": ("value", "attempt_number", "result_id"),
    "results": (
        "id",
        "average",
        "competition_id",
        "person_country_id",
        "person_id",
        "event_id",
        "round_type_id",
    ),
}
EXPORT_PREFIXES = ("wca_export_", "wca_exports_")
PAGE_SIZE = 50
LEVEL_ROW_LIMITS = {"WR": 6, "CR": 6, "NR": 13}
