"""Table schemas, source layouts and the fixed values the analyses rely on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


INT, BIGINT, DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
STRING, DATE, TIMESTAMP = T.StringType(), T.DateType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# --- stored tables ---------------------------------------------------------

TRIPS = _struct(
    duration=INT,
    start_date=TIMESTAMP,
    end_date=TIMESTAMP,
    start_station=STRING,
    end_station=STRING,
    bike_number=STRING,
    member_type=STRING,
)

NUMBERED_TRIPS = T.StructType([*TRIPS.fields, T.StructField("trip_id", BIGINT)])

# The stored table is partitioned by the first day of the month a trip starts in.
START_MONTH = "start_month"
STORED_TRIPS = T.StructType([*NUMBERED_TRIPS.fields, T.StructField(START_MONTH, DATE)])

STATIONS = _struct(
    capacity=INT,
    lat=DOUBLE,
    lon=DOUBLE,
    name=STRING,
    region_id=INT,
    short_name=STRING,
    station_id=INT,
)

REGIONS = _struct(region_id=INT, name=STRING, code=STRING)

EBIKES = _struct(bike_number=STRING)

# Kept beside a trips table: see ``plans/history.py``.
BIKE_NUMBERS = _struct(bike_number=STRING, bike_id=BIGINT, bucket=INT)
BIKE_LIVES = _struct(bike_number=STRING, first_start=TIMESTAMP, last_start=TIMESTAMP, bucket=INT)
DAILY_USAGE = _struct(
    date=DATE,
    bike_type=STRING,
    numbered=T.BooleanType(),
    trips=BIGINT,
    seconds=BIGINT,
    micros=BIGINT,
    timed=BIGINT,
    casual=BIGINT,
    member=BIGINT,
)
DAILY_SETS = _struct(date=DATE, bike_type=STRING, bitmap=BIGINT, bikes=T.BinaryType())

# Kept beside a table of device locations: see ``plans/vehicle_history.py``.
VEHICLE_DAYS = _struct(provider=STRING, bike_id=STRING, date=DATE, bucket=INT)
VEHICLE_FLAGS = _struct(
    provider=STRING,
    bike_id=STRING,
    bike=T.BooleanType(),
    scooter=T.BooleanType(),
    first_day=DATE,
    first_seen=TIMESTAMP,
    last_seen=TIMESTAMP,
    bucket=INT,
)
KIND_COUNTS = _struct(provider=STRING, date=DATE, bikes=BIGINT, scooters=BIGINT, vehicles=BIGINT)

# Weekly timetable of another transit service. Day 0 is Sunday; the bounds are
# microseconds since midnight and both belong to the period.
SERVICE_HOURS = _struct(day_of_week=INT, start_us=BIGINT, end_us=BIGINT, op_status=STRING)

DEVICE_LOCATIONS = _struct(created=TIMESTAMP, bike_id=STRING, provider=STRING, raw=STRING)

# Fields of a daily weather record, in the spelling of the record.
WEATHER_RECORD = _struct(
    apparentTemperatureHigh=DOUBLE,
    apparentTemperatureHighTime=BIGINT,
    apparentTemperatureLow=DOUBLE,
    apparentTemperatureLowTime=BIGINT,
    apparentTemperatureMax=DOUBLE,
    apparentTemperatureMaxTime=BIGINT,
    apparentTemperatureMin=DOUBLE,
    apparentTemperatureMinTime=BIGINT,
    cloudCover=DOUBLE,
    dewPoint=DOUBLE,
    humidity=DOUBLE,
    icon=STRING,
    moonPhase=DOUBLE,
    precipAccumulation=DOUBLE,
    precipIntensity=DOUBLE,
    precipIntensityMax=DOUBLE,
    precipIntensityMaxTime=BIGINT,
    precipProbability=DOUBLE,
    precipType=STRING,
    pressure=DOUBLE,
    summary=STRING,
    sunriseTime=BIGINT,
    sunsetTime=BIGINT,
    temperatureHigh=DOUBLE,
    temperatureHighTime=BIGINT,
    temperatureLow=DOUBLE,
    temperatureLowTime=BIGINT,
    temperatureMax=DOUBLE,
    temperatureMaxTime=BIGINT,
    temperatureMin=DOUBLE,
    temperatureMinTime=BIGINT,
    day_time=BIGINT,
    visibility=DOUBLE,
    weather_date=DATE,
    windBearing=DOUBLE,
    windSpeed=DOUBLE,
)

# The stored table has the same fields in lower case.
WEATHER = T.StructType([T.StructField(f.name.lower(), f.dataType) for f in WEATHER_RECORD])


# --- source layouts --------------------------------------------------------


@dataclass(frozen=True)
class TripLayout:
    """Which columns of a trip CSV become the trip columns, in their order.

    Either ``kept`` names all of them, or they are what is left without ``dropped``.
    """

    kept: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()

    def columns(self, header: list[str]) -> dict[str, str]:
        """Trip column to CSV column."""
        source = list(self.kept) or [h for h in header if h not in self.dropped]
        lacking = {*self.kept, *self.dropped} - set(header)
        if lacking or len(source) != len(TRIPS):
            raise ValueError(f"the header {header} does not fit {self}")
        return dict(zip(TRIPS.names, source, strict=True))


# The two station-name columns that are dropped from the first layout.
STATION_NUMBER_LAYOUT = TripLayout(dropped=("Start station", "End station"))

# The seven columns that are kept of the second layout.
STATION_ID_LAYOUT = TripLayout(
    kept=(
        "tripduration",
        "starttime",
        "stoptime",
        "start station id",
        "end station id",
        "bikeid",
        "usertype",
    )
)

# --- fixed values ----------------------------------------------------------

# A bike number that starts with one of these belongs to a classic bike.
CLASSIC_PREFIXES = ("?", "w", "W", "Z")

# Region of a station whose snapshot names none.
DEFAULT_REGION_ID = 42

# Short code of each region name.
REGION_CODES = {
    "Washington, DC": "WDC",
    "Arlington, VA": "ARL",
    "Montgomery County, MD (South)": "MCS",
    "Montgomery County, MD (North)": "MCN",
    "Alexandria, VA": "ALX",
    "Fairfax, VA": "FFX",
    "Prince George's County": "PGC",
}

# Readable name of each service status.
SERVICE_STATUS_LABELS = {
    "no_service": "No Metro Service",
    "regular": "Regular Operating Hours",
    "peak": "Peak Operating Hours",
}

# Mean earth radius, and kilometres in a mile.
EARTH_RADIUS_KM = 6371.009
KM_PER_MILE = 1.609344

# Upper limits of the distance, duration and speed curves.
DENSITY_MAX_MILES = 5.0
DENSITY_MAX_MINUTES = 60.0
DENSITY_MAX_MPH = 15.5
