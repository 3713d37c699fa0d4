"""Fixed values that must equal the original application's for equal results.

They are stated plainly, in their natural order, and used by name elsewhere.
Values marked DECISION are ours where the original is random or absent.
"""

# --- fixed values: raw header aliases -> canonical column -------------------
HEADER_ALIASES = {
    "Date": "date",
    "DATE": "date",
    "District": "district",
    "DISTRICT": "district",
    "Crime_Type": "crime_type",
    "CRIME_TYPE": "crime_type",
    "Crime Type": "crime_type",
    "Latitude": "latitude",
    "LATITUDE": "latitude",
    "LAT": "latitude",
    "Longitude": "longitude",
    "LONGITUDE": "longitude",
    "LON": "longitude",
    "LNG": "longitude",
}

# --- fixed values: fills for missing labels ---------------------------------
NULL_DISTRICT = "Unknown"
NULL_TYPE = "Other"
NULL_TYPE_UPLOAD = "General Crime"

# --- fixed values: calendar -------------------------------------------------
WEEKEND_DAYS = (5, 6)  # Monday = 0
TIME_OF_DAY = (("Night", 6), ("Morning", 12), ("Afternoon", 18), ("Evening", 24))  # right-closed upper bounds
SEASON_MONTHS = (("Summer", (4, 5, 6)), ("Winter", (11, 12, 1)), ("Monsoon", (7, 8, 9)))
SEASON_ELSE = "Spring"

# --- fixed values: training gates -------------------------------------------
MIN_ROWS = 100
MIN_MONTHS = 24
TRAIN_FRACTION = 0.8
SHORT_SPAN_DAYS = 365
LOOK_BACK = 12
RF_TREES = 100

# --- fixed values: forecast models, in tie-break order ----------------------
MODELS = ("arima", "sarima", "lstm")
SELECTION_CRITERIA = "Lowest Mean Absolute Error (MAE)"
SELECTION_NOTE = "%s selected with MAE of %.2f"

# --- fixed values: risk features and their defaults -------------------------
RISK_FEATURES = (
    ("total_crimes", 100.0),
    ("crime_rate", 10.0),
    ("violent_crimes", 10.0),
    ("property_crimes", 50.0),
    ("drug_crimes", 5.0),
    ("evening_crimes_pct", 30.0),
    ("night_crimes_pct", 15.0),
    ("weekend_crimes_pct", 25.0),
)
RISK_FEATURE_LABELS = (
    "Total Crimes",
    "Crime Rate",
    "Violent Crimes",
    "Property Crimes",
    "Drug Crimes",
    "Evening Crimes %",
    "Night Crimes %",
    "Weekend Crimes %",
)

# --- fixed values: rule risk score (feature, divisor, cap, weight) ----------
RISK_RULE = (
    ("crime_rate", 20.0, 1.0, 0.30),
    ("total_crimes", 200.0, 1.0, 0.25),
    ("violent_ratio", 1.0, 0.5, 0.20),
    ("evening_crimes_pct", 50.0, 1.0, 0.15),
    ("night_crimes_pct", 30.0, 1.0, 0.10),
)
RISK_HIGH = 0.7
RISK_MEDIUM = 0.4
RISK_LEVELS = ("High", "Medium", "Low")

# DECISION: centres of the original random bands (confidence; High, Medium, Low weights before normalising)
RISK_CONFIDENCE = {"High": 0.90, "Medium": 0.84, "Low": 0.86}
RISK_BANDS = {
    "High": (0.8, 0.2, 0.1),
    "Medium": (0.3, 0.6, 0.2),
    "Low": (0.1, 0.2, 0.8),
}

# --- fixed values: colours and hotspot levels -------------------------------
RISK_COLOURS = (("High", "red"), ("Medium", "orange"), ("Low", "green"))
HOTSPOT_HIGH = 150  # DECISION: consistent with the original's literal markers
HOTSPOT_MEDIUM = 95
HOTSPOT_RADIUS_PER_CASE = 20
