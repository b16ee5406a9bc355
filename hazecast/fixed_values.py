"""Names, thresholds and tables that results depend on."""

# --- Fixed values: column names ------------------------------------------
POLLUTANTS = ["pm2_5", "pm10", "no2", "so2", "o3", "co"]
WEATHER = ["temperature", "humidity", "wind_speed", "wind_direction", "pressure"]
WINDOWED = ["pm2_5", "pm10", "aqi"]
TARGETS = ["aqi_target_24h", "aqi_target_48h", "aqi_target_72h"]

# payload field -> column
AIR_QUALITY_FIELDS = {
    "pm2_5": "pm2_5",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "ozone": "o3",
    "carbon_monoxide": "co",
}
WEATHER_FIELDS = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_direction",
    "surface_pressure": "pressure",
}

# --- Fixed values: window sizes (rows, nominally hours) -------------------
ROLLING_WINDOWS = [6, 12, 24]
EWMA_SPANS = [6, 12, 24]
LAG_STEPS = [1, 3, 6, 12, 24]
CHANGE_WINDOWS = [3, 6, 12]
HORIZONS = [24, 48, 72]

# --- Fixed values: interaction pairs and day segments ---------------------
INTERACTION_PAIRS = [
    ("pm2_5", "humidity"),
    ("pm2_5", "wind_speed"),
    ("pm2_5", "pressure"),
    ("pm10", "temperature"),
    ("pm10", "wind_speed"),
    ("pm10", "humidity"),
]
# first hour (inclusive), last hour (exclusive); position = code
DAY_SEGMENTS = [(0, 6), (6, 12), (12, 18), (18, 24)]

# --- Fixed values: backfill and recent ranges -----------------------------
BACKFILL_CHUNK_DAYS = 30
RECENT_DAYS = 5
LIVE_DAYS = 7

# --- Fixed values: training ------------------------------------------------
TRAIN_FRACTION = 0.8
MIN_TRAINING_ROWS = 100
ALERT_THRESHOLD = 150

# --- Fixed values: EPA breakpoints (C_low, C_high, I_low, I_high) ----------
BREAKPOINTS = {
    "pm2_5": [
        (0.0, 12.0, 0, 50),
        (12.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 150.4, 151, 200),
        (150.5, 250.4, 201, 300),
        (250.5, 350.4, 301, 400),
        (350.5, 500.4, 401, 500),
    ],
    "pm10": [
        (0, 54, 0, 50),
        (55, 154, 51, 100),
        (155, 254, 101, 150),
        (255, 354, 151, 200),
        (355, 424, 201, 300),
        (425, 504, 301, 400),
        (505, 604, 401, 500),
    ],
    "no2": [
        (0, 100, 0, 50),
        (101, 188, 51, 100),
        (189, 677, 101, 150),
        (678, 1221, 151, 200),
        (1222, 2349, 201, 300),
        (2350, 3102, 301, 400),
        (3103, 3853, 401, 500),
    ],
    "so2": [
        (0, 93, 0, 50),
        (94, 197, 51, 100),
        (198, 486, 101, 150),
        (487, 797, 151, 200),
        (798, 1583, 201, 300),
        (1584, 2107, 301, 400),
        (2108, 2631, 401, 500),
    ],
    "o3": [
        (0, 108, 0, 50),
        (109, 137, 51, 100),
        (138, 167, 101, 150),
        (168, 392, 151, 200),
        (393, 784, 201, 300),
        (785, 980, 301, 400),
        (981, 1176, 401, 500),
    ],
    "co": [
        (0, 5152, 0, 50),
        (5153, 10944, 51, 100),
        (10945, 14198, 101, 150),
        (14199, 17452, 151, 200),
        (17453, 34904, 201, 300),
        (34905, 46538, 301, 400),
        (46539, 57590, 401, 500),
    ],
}
AQI_CAP = 500
POLLUTANT_NAMES = {
    "pm2_5": "PM2.5",
    "pm10": "PM10",
    "no2": "NO2",
    "so2": "SO2",
    "o3": "O3",
    "co": "CO",
}

# --- Fixed values: AQI categories (low, high, label, colour, message) ------
CATEGORIES = [
    (0, 50, "Good", "#00E400",
     "Air quality is satisfactory with little or no risk."),
    (51, 100, "Moderate", "#FFFF00",
     "Acceptable; moderate health concern for sensitive individuals."),
    (101, 150, "Unhealthy for Sensitive Groups", "#FF7E00",
     "Sensitive groups may experience health effects."),
    (151, 200, "Unhealthy", "#FF0000",
     "Everyone may begin to experience health effects."),
    (201, 300, "Very Unhealthy", "#8F3F97",
     "Health alert: everyone may experience serious effects."),
    (301, 500, "Hazardous", "#7E0023",
     "Health warning of emergency conditions for entire population."),
]

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
