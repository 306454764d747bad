"""Fixed values the results depend on."""

# US holidays covered by the holiday flag.
US_HOLIDAYS = (
    "2016-01-01", "2016-01-18", "2016-02-15", "2016-05-30", "2016-07-04",
    "2016-09-05", "2016-10-10", "2016-11-11", "2016-11-24", "2016-12-26",
    "2017-01-01", "2017-01-16", "2017-02-20", "2017-05-29", "2017-07-04",
    "2017-09-04", "2017-10-09", "2017-11-10", "2017-11-23", "2017-12-25",
    "2018-01-01", "2018-01-15", "2018-02-19", "2018-05-28", "2018-07-04",
    "2018-09-03", "2018-10-08", "2018-11-12", "2018-11-22", "2018-12-25",
    "2019-01-01",
)

# Full-scale voltage (V) and current (A) of the household meter.
VOLTAGE_SCALE = 460.0
CURRENT_SCALE = 52.5

# Split fractions.
TRAIN_FRACTION = 0.8
VALIDATION_WITHIN_TRAIN = 0.3
LOOKBACK_ROWS = 720
GROUP_SPLIT_FRACTIONS = (0.40, 0.20, 0.40)

# Search space of the sequence forecaster (low, high).
UNITS_RANGE = (32, 512)
LAYERS_RANGE = (1, 4)
SEQUENCE_RANGE = (3, 32)
LEARNING_RATE_RANGE = (0.005, 0.02)

# Assumed minutes per trial, fitness of a failed trial.
MINUTES_PER_TRIAL = 2.5
FAILED_TRIAL_FITNESS = 1e6

# Meter codes.

# Columns dropped before features are assembled.
DROPPED_COLUMNS = (
    "timestamp", "meter", "meter_reading", "sea_level_pressure",
    "wind_direction", "wind_speed", "dew_temperature",
)
