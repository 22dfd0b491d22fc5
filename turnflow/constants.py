"""Values that the jobs take as defaults."""

from __future__ import annotations

# Carriers, columns, thresholds and bucket ranges of the flight records.
CARRIERS = ("DL", "UA")
CAUSES = ("CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay")
FLAGS = ("Cancelled", "Diverted", "DepDel15", "ArrDel15")
INTS = (
    "CRSDepTime", "DepTime", "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn", "CRSArrTime", "ArrTime", "CRSElapsedTime",
    "ActualElapsedTime", "AirTime", "Distance", "Flight_Number_Reporting_Airline", "OriginAirportID", "DestAirportID",
)
DELAYS = ("DepDelay", "DepDelayMinutes", "ArrDelay", "ArrDelayMinutes")
CODES = ("Tail_Number", "CancellationCode")
CALENDAR = ("Year", "Month", "DayofMonth", "DayOfWeek")
KEEP = (
    "Year", "Month", "DayofMonth", "DayOfWeek", "FlightDate",
    "Reporting_Airline", "Tail_Number", "Flight_Number_Reporting_Airline",
    "OriginAirportID", "Origin", "OriginCityName", "OriginState",
    "DestAirportID", "Dest", "DestCityName", "DestState",
    "CRSDepTime", "DepTime", "DepDelay", "DepDelayMinutes", "DepDel15",
    "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn",
    "CRSArrTime", "ArrTime", "ArrDelay", "ArrDelayMinutes", "ArrDel15",
    "Cancelled", "CancellationCode", "Diverted",
    "CRSElapsedTime", "ActualElapsedTime", "AirTime", "Distance",
    "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
)

DEADBAND = 3
MIN_TURN_SHARE = 0.05
MIN_TURN, MAX_TURN = 20, 180
MIN_TURN_SAMPLES = 10
DAY_STARTS_MIN = 270

#: name, least and greatest whole minutes of a delay; null is open.
BUCKETS = (("on_time_or_early", None, 0), ("1_15", 1, 15), ("16_30", 16, 30), ("31_60", 31, 60), ("60_plus", 61, None))
POOL_SAMPLES = 30
POOL_CAP = 200
SAMPLE_SEED = "turn"

DRAWS = 2000
LATE_BY = (15, 30, 60)
ROTATIONS = 200
