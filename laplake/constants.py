"""Fixed values that results depend on."""

# Team colours of the service layer, first match wins.
TEAM_COLORS = {
    "red bull": "#3671C6",
    "ferrari": "#E8002D",
    "mercedes": "#27F4D2",
    "mclaren": "#FF8000",
    "aston martin": "#229971",
    "alpine": "#FF87BC",
    "williams": "#64C4FF",
    "rb": "#6692FF",
    "racing bulls": "#6692FF",
    "kick sauber": "#52E252",
    "sauber": "#52E252",
    "haas": "#B6BABD",
    "audi": "#BB0000",
    "cadillac": "#1F3275",
    "andretti": "#1F3275",
    "general motors": "#1F3275",
}

# Team colours of the display layer, first match wins.
DISPLAY_TEAM_COLORS = {
    "mercedes": "#27F4D2",
    "ferrari": "#E8002D",
    "mclaren": "#FF8000",
    "red bull": "#1E2248",
    "aston martin": "#00665E",
    "alpine": "#1E41FF",
    "rb": "#1E41FF",
    "racing bulls": "#1E41FF",
    "williams": "#1E5BFF",
    "kick sauber": "#C00000",
    "sauber": "#C00000",
    "audi": "#D50000",
    "haas": "#F2F2F2",
    "cadillac": "#1B1B1B",
    "andretti": "#1F3275",
    "general motors": "#1F3275",
}

DEFAULT_COLOR = "#888888"

# Country to flag code.
COUNTRY_CODES = {
    "Australia": "au",
    "China": "cn",
    "Japan": "jp",
    "Bahrain": "bh",
    "Saudi Arabia": "sa",
    "USA": "us",
    "United States": "us",
    "Italy": "it",
    "Monaco": "mc",
    "Canada": "ca",
    "Spain": "es",
    "Austria": "at",
    "UK": "gb",
    "Great Britain": "gb",
    "Hungary": "hu",
    "Belgium": "be",
    "Netherlands": "nl",
    "Singapore": "sg",
    "Mexico": "mx",
    "Brazil": "br",
    "UAE": "ae",
    "Abu Dhabi": "ae",
    "Azerbaijan": "az",
    "Qatar": "qa",
    "Las Vegas": "us",
    "Miami": "us",
}
DEFAULT_FLAG = "un"

# Surnames by car number.
DRIVER_SURNAMES = {
    1: "Verstappen", 11: "Perez", 44: "Hamilton", 63: "Russell",
    16: "Leclerc", 55: "Sainz", 4: "Norris", 81: "Piastri",
    14: "Alonso", 18: "Stroll", 10: "Gasly", 31: "Ocon",
    23: "Albon", 2: "Sargeant", 77: "Bottas", 24: "Zhou",
    20: "Magnussen", 27: "Hulkenberg", 3: "Ricciardo", 22: "Tsunoda",
}

# Track status labels.
TRACK_STATUS_LABELS = {
    "1": "Track Clear",
    "2": "Yellow Flag",
    "4": "Safety Car",
    "5": "Red Flag",
    "6": "Virtual Safety Car",
    "7": "VSC Ending",
}
TRACK_CLEAR = "1"

# Message topics.
LAP_TOPIC = "f1.lap.data"
PIT_TOPIC = "f1.pit.stops"
POSITION_TOPIC = "f1.positions"
SESSION_TOPIC = "f1.session.events"
DRIVER_TOPIC = "f1.driver.info"

# Thresholds.
MIN_LAP_SECONDS = 60.0
MAX_LAP_SECONDS = 200.0
ROLLING_LAPS = 5
MIN_DEGRADATION = -0.5
MAX_DEGRADATION = 1.5
PIT_THRESHOLD = 0.15
NO_PIT_ESTIMATE = 999.0
UNPLACED = 99
SLOW_STOP_SECONDS = 40.0
FIRST_SEASON = 2023
CAREER_SEASONS = (2020, 2021, 2022, 2023, 2024)
CIRCUIT_SEASONS = (2018, 2019, 2020, 2021, 2022, 2023, 2024)
EMBEDDING_BATCH = 64

# Report texts.
PIT_SOON_TEXT = "should pit soon"
PIT_LATER_TEXT = "pit not needed yet"
CONTEXT_TITLE = "Relevant historical F1 situations:\n"
CONTEXT_EMPTY = "No similar historical situations found."
MINIMAL_WEAR_TEXT = "minimal degradation, tyres still feeling strong"
BOX_TEXT = "box box box — pit window is open"
STAY_OUT_TEXT = "stay out, tyres look okay"
NO_FLAG_TEXT = "no pit flag, tyres look ok for now"
