"""For each registered query, SQL that another engine runs on the same tables.

The SQL states what is asked in the plainest form (range joins, correlated
counts, membership tests), not in the form the Spark jobs use.
"""

from __future__ import annotations

import re

from checks import registry as r
from spokeworks.schemas import REGION_CODES, SERVICE_STATUS_LABELS


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(str(v)) for v in row) + ")" for row in rows)


def _round(sql: str) -> str:
    return f"round({sql}, {r.DIGITS})"


_FIRST, _LAST = f"DATE '{r.FIRST}'", f"DATE '{r.LAST}'"
_US = "date_diff('microsecond', start_date, end_date)"
_TYPE = "CASE WHEN left(bike_number, 1) IN ('?', 'w', 'W', 'Z') THEN 'Classic' ELSE 'Plus' END"
_AVG_SECONDS = _round(f"sum({_US}) / 1e6 / count(*)") + " AS avg_seconds"

# Named sub-queries. Each is put before a query that mentions it, with those
# it mentions itself.
_VIEWS = {
    "trips": """
        SELECT event_id AS trip_id,
               CAST(floor(value * 20) AS INTEGER) - 200 AS duration,
               ts AS start_date,
               ts + to_seconds(CAST(floor(value * 20) AS INTEGER) - 200) AS end_date,
               CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 30 AS VARCHAR)
                   AS start_station,
               CAST(event_id % 30 AS VARCHAR) AS end_station,
               CASE WHEN user_id % 50 = 49 THEN NULL ELSE concat(
                   CASE user_id % 6 WHEN 0 THEN 'W' WHEN 1 THEN 'w' WHEN 2 THEN '?'
                       WHEN 3 THEN 'Z' WHEN 4 THEN 'E' ELSE '' END,
                   CAST(user_id AS VARCHAR)) END AS bike_number,
               CASE event_type WHEN 'signup' THEN 'Casual' WHEN 'error' THEN 'Other'
                   ELSE 'Member' END AS member_type
        FROM events""",
    "stations": """
        SELECT CAST(n_nationkey + 10 AS INTEGER) AS capacity,
               CASE WHEN n_nationkey = 24 THEN 0.0
                   ELSE CAST(38.80 + n_nationkey * 0.01 AS DOUBLE) END AS lat,
               CASE WHEN n_nationkey = 24 THEN 0.0
                   ELSE CAST(-77.20 + ((n_nationkey * 7) % 25) * 0.01 AS DOUBLE) END AS lon,
               n_name AS name, n_regionkey AS region_id,
               CAST(n_nationkey AS VARCHAR) AS short_name, n_nationkey AS station_id
        FROM nation""",
    "stored_stations": """
        SELECT CAST(s_suppkey % 40 AS INTEGER) AS capacity,
               CAST(38.0 + (s_suppkey % 90) * 0.01 AS DOUBLE) AS lat,
               CAST(-77.0 - (s_suppkey % 80) * 0.01 AS DOUBLE) AS lon,
               s_name AS name, CAST(s_nationkey AS INTEGER) AS region_id,
               CAST(s_suppkey AS VARCHAR) AS short_name,
               CAST(1000 + s_suppkey AS INTEGER) AS station_id
        FROM supplier""",
    "weather": """
        SELECT CAST(ts AS DATE) AS weather_date,
               count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE)
                   AS precipprobability
        FROM events GROUP BY 1""",
    "service_hours": """
        SELECT n_nationkey // 5 + 1 AS day_of_week,
               CAST([0, 18000, 34200, 54000, 68401][n_nationkey % 5 + 1] AS BIGINT) * 1000000
                   AS start_us,
               CAST([17999, 34200, 54000, 68400, 84600][n_nationkey % 5 + 1] AS BIGINT) * 1000000
                   AS end_us,
               ['no_service', 'peak', 'regular', 'peak', 'regular'][n_nationkey % 5 + 1]
                   AS op_status
        FROM nation""",
    "bike_locations": """
        SELECT ts AS created,
               concat('v', CAST(user_id AS VARCHAR), '-',
                   CAST((day(ts) + user_id % 9) // 13 AS VARCHAR)) AS bike_id,
               CASE WHEN user_id % 10 = 9 THEN 'other' ELSE 'main' END AS provider,
               CASE WHEN user_id % 3 = 0 AND event_type = 'click' THEN 'scooter'
                   WHEN user_id % 3 = 1 AND event_type <> 'view' THEN 'bike' END AS kind
        FROM events""",
    "long_trips": """
        SELECT CAST(l_quantity AS INTEGER) AS duration, o_orderdate AS start_date,
               l_shipdate AS end_date, CAST(l_suppkey AS VARCHAR) AS start_station,
               CAST(l_partkey AS VARCHAR) AS end_station,
               CAST(o_custkey AS VARCHAR) AS bike_number,
               CASE l_linestatus WHEN 'O' THEN 'Subscriber' ELSE 'Customer' END AS member_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # trips that start in the period and end after they start
    "forward": f"""
        SELECT *, {_TYPE} AS bike_type, {_US} AS us FROM trips
        WHERE start_date >= {_FIRST} AND end_date > start_date""",
    "short_same": """
        SELECT * FROM forward
        WHERE member_type = 'Member' AND start_station = end_station AND us < 3600000000""",
    "hist": """
        SELECT bike_type, us AS duration_us, count(*) AS trips FROM short_same GROUP BY ALL""",
    # fleet and daily counts
    "days": f"""
        SELECT CAST(unnest(generate_series({_FIRST}, {_LAST}, INTERVAL 1 DAY)) AS DATE) AS date""",
    "bike_life": """
        SELECT bike_number, left(bike_number, 1) IN ('?', 'w', 'W', 'Z') AS classic,
               CAST(min(start_date) AS DATE) AS lo,
               CAST(date_trunc('month', max(start_date)) + INTERVAL 1 MONTH AS DATE) AS hi
        FROM trips GROUP BY 1""",
    "per_day": f"""
        SELECT CAST(start_date AS DATE) AS date,
               count(bike_number) FILTER (WHERE classic) AS classic_trips,
               count(bike_number) FILTER (WHERE NOT classic) AS plus_trips,
               count(*) AS total_trips,
               count(DISTINCT bike_number) FILTER (WHERE classic) AS classic_used,
               count(DISTINCT bike_number) FILTER (WHERE NOT classic) AS plus_used
        FROM (SELECT *, left(bike_number, 1) IN ('?', 'w', 'W', 'Z') AS classic FROM trips)
        WHERE start_date >= {_FIRST} GROUP BY 1""",
    "fleet": """
        SELECT date,
               count(DISTINCT bike_number) FILTER (WHERE classic) AS classic_fleet,
               count(DISTINCT bike_number) FILTER (WHERE NOT classic) AS plus_fleet,
               count(DISTINCT bike_number) AS total_fleet
        FROM (SELECT date FROM days UNION SELECT date FROM per_day) AS d
        LEFT JOIN bike_life ON d.date BETWEEN lo AND hi GROUP BY 1""",
    "utilisation": """
        SELECT days.date, precipprobability AS rain_probability, classic_trips, plus_trips,
               classic_used, plus_used, classic_fleet, plus_fleet
        FROM days LEFT JOIN per_day USING (date) LEFT JOIN fleet USING (date)
        LEFT JOIN weather ON days.date = weather_date""",
    "daily_shares": """
        SELECT date, classic_trips, plus_trips, plus_used,
               (SELECT sum(classic_trips) FROM per_day) AS total_classic_trips,
               (SELECT sum(plus_trips) FROM per_day) AS total_plus_trips
        FROM per_day""",
    "plus_shares": """
        SELECT days.date, plus_trips, classic_trips, total_trips,
               plus_trips / CAST(total_trips AS DOUBLE) AS plus_trip_share,
               plus_fleet, total_fleet,
               CASE WHEN total_fleet > 0 THEN plus_fleet / CAST(total_fleet AS DOUBLE) END
                   AS plus_fleet_share
        FROM days LEFT JOIN per_day USING (date) LEFT JOIN fleet USING (date)""",
    # distance
    "located": """
        SELECT forward.*, a.lat AS start_lat, a.lon AS start_lon, b.lat AS end_lat,
               b.lon AS end_lon
        FROM forward
        LEFT JOIN stations AS a ON start_station = a.short_name
        LEFT JOIN stations AS b ON end_station = b.short_name
        WHERE member_type = 'Member'""",
    "measured": """
        SELECT *, miles / hours AS mph FROM (
            SELECT *, us / 3.6e9 AS hours, us / 6e7 AS minutes,
                   atan2(
                       sqrt(pow(cos(radians(end_lat))
                               * sin(radians(end_lon) - radians(start_lon)), 2)
                           + pow(cos(radians(start_lat)) * sin(radians(end_lat))
                               - sin(radians(start_lat)) * cos(radians(end_lat))
                                   * cos(radians(end_lon) - radians(start_lon)), 2)),
                       sin(radians(start_lat)) * sin(radians(end_lat))
                           + cos(radians(start_lat)) * cos(radians(end_lat))
                               * cos(radians(end_lon) - radians(start_lon))
                   ) * 6371.009 / 1.609344 AS miles
            FROM located)""",
    "curve_values": """
        SELECT 'miles' AS measure, bike_type, miles AS v FROM measured WHERE miles <= 5
        UNION ALL
        SELECT 'minutes', bike_type, minutes FROM measured WHERE minutes <= 60
        UNION ALL
        SELECT 'mph', bike_type, mph FROM measured WHERE mph > 0 AND mph < 15.5""",
    "curve_shape": """
        SELECT measure, bike_type, count(*) AS n,
               stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi
        FROM curve_values GROUP BY ALL""",
    "miles_shape": """
        SELECT bike_type, count(miles) AS n, stddev_samp(miles) * pow(count(miles), -0.2) AS h,
               min(miles) AS lo, max(miles) AS hi
        FROM measured GROUP BY 1""",
    # service hours
    "hourly": f"""
        SELECT CASE
                   WHEN left(bike_number, 1) NOT IN ('?', 'w', 'W', 'Z') THEN 'Plus'
                   WHEN bike_number IS NOT NULL AND member_type IN ('Member', 'Casual')
                       THEN 'Classic, ' || member_type END AS trip_type,
               day_of_week, op_status
        FROM (SELECT *, date_diff('microsecond', date_trunc('day', start_date), start_date) AS at_us
              FROM trips
              WHERE start_date >= {_FIRST} AND dayofweek(start_date) NOT IN (0, 6))
        LEFT JOIN service_hours
            ON dayofweek(start_date) = day_of_week AND at_us >= start_us AND at_us <= end_us""",
    "hour_counts": """
        SELECT trip_type, day_of_week, op_status,
               (SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM hourly AS t
                WHERE t.trip_type = hourly.trip_type) AS type_total,
               count(*) AS trips
        FROM hourly GROUP BY trip_type, day_of_week, op_status""",
    # vehicles
    "main_locations": f"SELECT * FROM bike_locations WHERE provider = '{r.PROVIDER}'",
    "bikes": f"""
        SELECT bike_id FROM main_locations GROUP BY bike_id
        HAVING min(CAST(created AS DATE)) < DATE '{r.BIKES_BEFORE}'
        UNION SELECT bike_id FROM main_locations WHERE kind = 'bike'""",
    "scooters": "SELECT DISTINCT bike_id FROM main_locations WHERE kind = 'scooter'",
    "kinds": """
        SELECT *, vehicles - bikes - scooters AS unknown FROM (
            SELECT CAST(created AS DATE) AS date,
                   count(DISTINCT CASE WHEN bike_id IN (SELECT bike_id FROM bikes)
                       THEN bike_id END) AS bikes,
                   count(DISTINCT CASE WHEN bike_id IN (SELECT bike_id FROM scooters)
                       THEN bike_id END) AS scooters,
                   count(DISTINCT bike_id) AS vehicles
            FROM main_locations GROUP BY 1)""",
    "apportioned": """
        SELECT date,
               CAST(trunc(bikes + CAST(bikes AS DOUBLE) / (bikes + scooters) * unknown) AS BIGINT)
                   AS bikes,
               CAST(trunc(scooters + CAST(scooters AS DOUBLE) / (bikes + scooters) * unknown)
                   AS BIGINT) AS scooters,
               bikes AS known_bikes, scooters AS known_scooters, vehicles, unknown
        FROM kinds""",
    "timeline": f"""
        SELECT CAST(d AS DATE) AS date, vehicle, event
        FROM (VALUES {_values(r.EVENTS)}) AS t(d, vehicle, event)""",
    # second system
    "long_days": f"""
        SELECT CAST(unnest(generate_series(DATE '{r.LONG_FIRST}', DATE '{r.LONG_LAST}',
            INTERVAL 1 DAY)) AS DATE) AS date""",
    "ebikes": f"""
        SELECT bike_number FROM long_trips GROUP BY bike_number
        HAVING min(CAST(start_date AS DATE)) >= DATE '{r.EBIKE_FIRST}'
           AND min(CAST(start_date AS DATE)) <= DATE '{r.EBIKE_LAST}'""",
    "long_flagged": """
        SELECT *, bike_number IN (SELECT bike_number FROM ebikes) AS electric FROM long_trips""",
    "long_life": """
        SELECT bike_number, electric, CAST(min(start_date) AS DATE) AS lo,
               CAST(date_trunc('month', max(start_date)) + INTERVAL 1 MONTH AS DATE) AS hi
        FROM long_flagged GROUP BY 1, 2""",
    "long_per_day": """
        SELECT CAST(start_date AS DATE) AS date,
               count(*) FILTER (WHERE NOT electric) AS trips,
               count(*) FILTER (WHERE electric) AS ebike_trips
        FROM long_flagged GROUP BY 1""",
}

_DATE = "CAST(date AS VARCHAR) AS date"


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


def _ratio(kind: str, bikes: str) -> str:
    return f"CAST({kind}_trips AS DOUBLE) / nullif({kind}_{bikes}, 0)"


def _per_bike_long(bikes: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {_DATE}, {_round('rain_probability')} AS rain_probability, "
        f"'{kind.title()}' AS bike_type, {_round(_ratio(kind, bikes))} AS trips_per_bike "
        "FROM utilisation"
        for kind in ("classic", "plus")
    )


def _overall(kind: str, bikes: str) -> str:
    total = f"sum({kind}_trips) / CAST(sum({kind}_{bikes}) AS DOUBLE)"
    return f"{_round(total)} AS {kind}_trips_per_{bikes}_bike"


def _by_station(member_type: str) -> str:
    return f"""
        SELECT '{member_type}' AS member_type, start_station, name AS start_name,
               count(*) AS total_trips
        FROM forward LEFT JOIN stations ON start_station = short_name
        WHERE member_type = '{member_type}' GROUP BY start_station, name"""


def _top_routes() -> str:
    branches = " UNION ALL ".join(
        f"""(SELECT '{kind}' AS bike_type, start_station, end_station, count(*) AS total_trips
             FROM forward WHERE member_type = 'Member' AND bike_number IS NOT NULL
                 AND bike_type = '{kind}'
             GROUP BY start_station, end_station
             ORDER BY count(*) DESC, start_station NULLS LAST, end_station NULLS LAST LIMIT 10)"""
        for kind in ("Classic", "Plus")
    )
    return f"""
        SELECT top.bike_type, top.start_station, top.end_station, total_trips,
               a.name AS start_name, {_round('a.lat')} AS start_lat, {_round('a.lon')} AS start_lon,
               b.name AS end_name, {_round('b.lat')} AS end_lat, {_round('b.lon')} AS end_lon,
               {_round('miles')} AS miles
        FROM ({branches}) AS top
        LEFT JOIN stations AS a ON top.start_station = a.short_name
        LEFT JOIN stations AS b ON top.end_station = b.short_name
        LEFT JOIN (SELECT DISTINCT start_station, end_station, miles FROM measured) AS m
            ON m.start_station = top.start_station AND m.end_station = top.end_station"""


_STATUS = " ".join(
    f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in SERVICE_STATUS_LABELS.items()
)
_TRIP_COLUMNS = (
    f"duration, {_stamp('start_date')}, {_stamp('end_date')}, start_station, end_station, "
    "bike_number, member_type"
)

_REASON = " ".join(f"WHEN {k} THEN {_literal(v)}" for k, v in r.DAMAGE.items())

_QUERIES = {
    "append_checked_trips": f"""
        SELECT {_TRIP_COLUMNS}, row_number() OVER (ORDER BY trip_id) AS trip_id
        FROM (SELECT * REPLACE (date_trunc('second', start_date) AS start_date) FROM trips
              WHERE trip_id % {r.DAMAGE_EVERY} NOT IN ({", ".join(map(str, r.DAMAGE))}))""",
    "rejected_trips": f"""
        SELECT CASE trip_id % {r.DAMAGE_EVERY} {_REASON} END AS reason,
               {r._damaged_line("strftime(start_date, '%-m/%-d/%Y %-H:%M:%S')",
                                "CAST(end_date AS VARCHAR)").replace("STRING", "VARCHAR")} AS record
        FROM trips WHERE trip_id % {r.DAMAGE_EVERY} IN ({", ".join(map(str, r.DAMAGE))})""",
    "stored_last_trip_id": "SELECT count(*) AS last_id FROM trips",
    "appended_key_violations": f"""
        SELECT bike_number, start_station FROM trips WHERE start_date >= DATE '{r.STORED_UNTIL}'
        GROUP BY 1, 2 HAVING count(*) > 1 OR bike_number IS NULL OR start_station IS NULL
        UNION ALL
        SELECT bike_number, start_station FROM trips AS stored
        WHERE start_date < DATE '{r.STORED_UNTIL}' AND EXISTS (
            SELECT 1 FROM trips AS new WHERE new.start_date >= DATE '{r.STORED_UNTIL}'
            AND new.bike_number = stored.bike_number
            AND new.start_station = stored.start_station)""",
    "avg_duration_by_date": f"""
        SELECT CAST(CAST(start_date AS DATE) AS VARCHAR) AS date, bike_type, {_AVG_SECONDS}
        FROM forward GROUP BY 1, 2""",
    "avg_duration_by_dow": f"""
        SELECT CAST(dayofweek(start_date) AS INTEGER) AS dow, bike_type, {_AVG_SECONDS}
        FROM forward GROUP BY 1, 2""",
    "avg_duration_by_date_members": f"""
        SELECT CAST(CAST(start_date AS DATE) AS VARCHAR) AS date, bike_type, {_AVG_SECONDS}
        FROM forward WHERE member_type = 'Member' GROUP BY 1, 2""",
    "monthly_basic_stats": f"""
        SELECT CAST(month(start_date) AS INTEGER) AS month, {_TYPE} AS bike_type,
               count(*) AS trips, count(DISTINCT bike_number) AS bikes, {_AVG_SECONDS},
               {_round("avg(CASE WHEN member_type = 'Member' THEN 1.0 ELSE 0.0 END)")}
                   AS member_share,
               count(*) FILTER (WHERE member_type = 'Casual') AS casual_trips,
               count(*) FILTER (WHERE member_type = 'Member') AS member_trips
        FROM trips WHERE start_date >= {_FIRST} GROUP BY 1, 2""",
    "casual_trips_by_station": _by_station("Casual"),
    "member_trips_by_station": _by_station("Member"),
    "same_station_share": f"""
        SELECT bike_type, {_round('''count(*) FILTER (WHERE start_station = end_station)
                   / CAST(count(*) AS DOUBLE)''')} AS same_station_share
        FROM forward WHERE member_type = 'Member' GROUP BY 1""",
    "same_station_duration_stats": f"""
        SELECT bike_type, {_round('min(us) / 1e6')} AS min_seconds,
               {_round('sum(us) / 1e6 / count(*)')} AS avg_seconds,
               {_round('max(us) / 1e6')} AS max_seconds
        FROM short_same GROUP BY 1""",
    "same_station_duration_hist": "SELECT * FROM hist",
    "same_station_duration_cdf": f"""
        SELECT bike_type, {_round('duration_us / 6e7')} AS minutes, trips,
               {_round('''CAST(sum(trips) OVER (PARTITION BY bike_type ORDER BY duration_us)
                   AS DOUBLE) / sum(trips) OVER (PARTITION BY bike_type)''')} AS running_share
        FROM hist""",
    "daily_fleet_calendar": f"""
        SELECT {_DATE}, classic_trips, plus_trips, classic_fleet, plus_fleet FROM utilisation""",
    "daily_fleet_trip_days": f"""
        SELECT {_DATE}, classic_trips, plus_trips, classic_used, plus_used, classic_fleet,
               plus_fleet
        FROM per_day JOIN fleet USING (date)""",
    "ebike_fleet_calendar": f"""
        SELECT {_DATE}, trips, ebike_trips,
               count(DISTINCT bike_number) FILTER (WHERE NOT electric) AS bikes,
               count(DISTINCT bike_number) FILTER (WHERE electric) AS ebikes
        FROM long_days LEFT JOIN long_per_day USING (date)
        LEFT JOIN long_life ON date BETWEEN lo AND hi
        GROUP BY ALL""",
    "first_seen_in_window": "SELECT bike_number FROM ebikes",
    "daily_utilisation": f"""
        SELECT * REPLACE (CAST(date AS VARCHAR) AS date,
            {_round('rain_probability')} AS rain_probability)
        FROM utilisation""",
    "trips_per_fleet_bike_long": _per_bike_long("fleet"),
    "trips_per_used_bike_long": _per_bike_long("used"),
    "overall_trips_per_bike": f"""
        SELECT {_overall('classic', 'fleet')}, {_overall('plus', 'fleet')},
               {_overall('classic', 'used')}, {_overall('plus', 'used')}
        FROM utilisation""",
    "daily_share_of_total": f"""
        SELECT {_DATE}, classic_trips, plus_trips, plus_used,
               CAST(total_classic_trips AS BIGINT) AS total_classic_trips,
               CAST(total_plus_trips AS BIGINT) AS total_plus_trips,
               {_round('classic_trips / CAST(total_classic_trips AS DOUBLE)')} AS classic_share,
               {_round('plus_trips / CAST(total_plus_trips AS DOUBLE)')} AS plus_share
        FROM daily_shares""",
    "daily_share_long": " UNION ALL ".join(
        f"""SELECT {_DATE}, plus_used, '{kind.title()}' AS bike_type,
                   {_round(f'{kind}_trips / CAST(total_{kind}_trips AS DOUBLE)')} AS share
            FROM daily_shares"""
        for kind in ("classic", "plus")
    ),
    "fleet_vs_trip_share": f"""
        SELECT * REPLACE (CAST(date AS VARCHAR) AS date,
            {_round('plus_trip_share')} AS plus_trip_share,
            {_round('plus_fleet_share')} AS plus_fleet_share)
        FROM plus_shares""",
    "fleet_vs_trip_share_long": f"""
        SELECT {_DATE}, '% of Trips' AS stat_type, {_round('plus_trip_share')} AS plus_stat,
               'Plus Trips' AS trip_type, plus_trips AS daily_trips FROM plus_shares
        UNION ALL
        SELECT {_DATE}, '% of Fleet', {_round('plus_fleet_share')}, 'Classic Trips', classic_trips
        FROM plus_shares""",
    "trip_distance_speed": f"""
        SELECT trip_id, CAST(CAST(start_date AS DATE) AS VARCHAR) AS date, bike_type,
               start_station, end_station, us AS duration_us,
               {_round('start_lat')} AS start_lat, {_round('start_lon')} AS start_lon,
               {_round('end_lat')} AS end_lat, {_round('end_lon')} AS end_lon,
               {_round('hours')} AS hours, {_round('minutes')} AS minutes,
               {_round('miles')} AS miles, {_round('mph')} AS mph
        FROM measured""",
    "avg_distance_speed_by_type": f"""
        SELECT bike_type, {_round('avg(miles) FILTER (WHERE miles > 0)')} AS avg_miles,
               {_round('avg(mph) FILTER (WHERE miles > 0)')} AS avg_mph,
               {_round('avg(minutes) FILTER (WHERE minutes > 0)')} AS avg_minutes
        FROM measured GROUP BY 1""",
    "daily_distance_speed": f"""
        SELECT CAST(CAST(start_date AS DATE) AS VARCHAR) AS date, bike_type,
               {_round('avg(miles)')} AS avg_miles, {_round('avg(mph)')} AS avg_mph
        FROM measured GROUP BY 1, 2""",
    # a kernel for each single value
    "density_curves": f"""
        SELECT measure, bike_type, CAST(point AS INTEGER) AS point, {_round('x')} AS x,
               round(sum(exp(-pow((x - v) / h, 2) / 2))
                   / (any_value(n) * any_value(h) * sqrt(2 * pi())), {r.DENSITY_DIGITS}) AS density
        FROM (SELECT *, lo - 3 * h + point * (hi - lo + 6 * h) / 99 AS x
              FROM curve_shape, range(100) AS g(point) WHERE h > 0) AS s
        JOIN curve_values AS b USING (measure, bike_type)
        GROUP BY measure, bike_type, point, x""",
    "distance_density": f"""
        SELECT bike_type, CAST(point AS INTEGER) AS point, {_round('x')} AS x,
               round(sum(exp(-pow((x - miles) / h, 2) / 2))
                   / (any_value(n) * any_value(h) * sqrt(2 * pi())), {r.DENSITY_DIGITS}) AS density
        FROM (SELECT *, lo - 3 * h + point * (hi - lo + 6 * h) / 99 AS x
              FROM miles_shape, range(100) AS g(point) WHERE h > 0) AS s
        JOIN measured USING (bike_type)
        WHERE miles IS NOT NULL
        GROUP BY bike_type, point, x""",
    "top_routes": _top_routes(),
    "trips_by_service_hours": """
        SELECT trip_type, day_of_week, op_status, type_total, trips FROM hour_counts""",
    "service_hours_share": f"""
        SELECT trip_type, day_of_week, CASE op_status {_STATUS} END AS op_status, type_total,
               trips, {_round('trips / CAST(type_total AS DOUBLE)')} AS trip_share
        FROM hour_counts""",
    "daily_vehicle_kinds": "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM kinds",
    "vehicle_kinds_apportioned": f"""
        SELECT {_DATE}, bikes, scooters, known_bikes, known_scooters, vehicles, unknown
        FROM apportioned""",
    "vehicle_kinds_long_events": """
        SELECT CAST(long.date AS VARCHAR) AS date, long.vehicle, on_street,
               coalesce(event, '') AS event
        FROM (SELECT date, 'bikes' AS vehicle, bikes AS on_street FROM apportioned
              UNION ALL SELECT date, 'scooters', scooters FROM apportioned) AS long
        LEFT JOIN timeline ON timeline.date = long.date AND timeline.vehicle = long.vehicle""",
    "total_scooters": """
        SELECT count(DISTINCT bike_id) AS scooters FROM bike_locations WHERE kind = 'scooter'""",
    "total_vehicles": "SELECT count(DISTINCT bike_id) AS vehicles FROM main_locations",
    "avg_vehicle_age": f"""
        SELECT {_round("sum(date_diff('microsecond', lo, hi)) / 8.64e10 / count(*)")} AS avg_days
        FROM (SELECT bike_id, min(created) AS lo, max(created) AS hi FROM main_locations
              WHERE bike_id IN (SELECT bike_id FROM bike_locations WHERE kind = 'scooter')
              GROUP BY 1)
        WHERE lo <= TIMESTAMP '{r.SEEN_BY}'""",
    "first_trip_per_bike": f"""
        SELECT bike_number, {_stamp('first_start')}
        FROM (SELECT bike_number, min(start_date) AS first_start FROM trips
              WHERE bike_number IS NOT NULL GROUP BY 1)""",
    "ingest_station_number_layout": f"SELECT {_TRIP_COLUMNS} FROM trips",
    "ingest_station_id_layout": f"SELECT {_TRIP_COLUMNS} FROM long_trips",
    "append_trips": f"""
        SELECT {_TRIP_COLUMNS},
               CASE WHEN new THEN
                   (SELECT max(trip_id) FROM trips
                    WHERE start_date < DATE '{r.STORED_UNTIL}')
                   + row_number() OVER (PARTITION BY new ORDER BY trip_id)
               ELSE trip_id END AS trip_id
        FROM (SELECT *, start_date >= DATE '{r.STORED_UNTIL}' AS new FROM trips)""",
    "ingest_trips_by_year": f"""
        SELECT {_TRIP_COLUMNS}, CAST(year(start_date) AS INTEGER) AS file_year
        FROM long_trips""",
    "last_trip_id": "SELECT max(trip_id) AS last_id FROM trips",
    "replace_year_partitions": """
        SELECT CAST(year(start_date) AS INTEGER) AS file_year, count(*) AS trips
        FROM long_trips GROUP BY 1""",
    "upsert_stations": f"""
        SELECT * REPLACE ({_round('lat')} AS lat, {_round('lon')} AS lon) FROM (
            SELECT * REPLACE (CASE WHEN region_id > 0 THEN region_id ELSE 42 END AS region_id)
            FROM stations
            UNION ALL
            SELECT * FROM stored_stations
            WHERE short_name NOT IN (SELECT short_name FROM stations))""",
    "ingest_regions": f"""
        SELECT region_id, regions.name, code
        FROM (SELECT r_regionkey AS region_id,
                     CASE r_regionkey WHEN 0 THEN 'Washington, DC' WHEN 1 THEN 'Arlington, VA'
                         WHEN 2 THEN 'Fairfax, VA' ELSE r_name END AS name
              FROM region) AS regions
        LEFT JOIN (VALUES {_values(REGION_CODES.items())}) AS codes(name, code) USING (name)""",
    "ingest_weather": f"""
        SELECT CAST(weather_date AS VARCHAR) AS weather_date,
               {_round('precipprobability')} AS precipprobability,
               CASE WHEN day(weather_date) % 2 = 0 THEN 'rain' ELSE '0' END AS preciptype,
               concat('day ', day(weather_date)) AS summary,
               CAST(0 AS BIGINT) AS day_time, CAST(0 AS DOUBLE) AS windspeed
        FROM weather""",
    "build_ebike_table": "SELECT bike_number FROM ebikes",
    "bulk_copy": f"SELECT {_TRIP_COLUMNS}, trip_id FROM trips",
    "export_texts": f"""
        SELECT event_id, piece, event_type || piece || props AS longer
        FROM (SELECT *, ([{", ".join(_literal(x) for x in r.AWKWARD)}, NULL])
                  [CAST(event_id % {len(r.AWKWARD) + 1} AS INTEGER) + 1] AS piece FROM events)""",
    "key_violations": """
        SELECT bike_number, start_station, count(*) AS n FROM trips GROUP BY 1, 2
        HAVING count(*) > 1 OR bike_number IS NULL OR start_station IS NULL""",
}


def _mentioned(sql: str) -> list[str]:
    return [name for name in _VIEWS if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", sql)]


def _with_views(sql: str) -> str:
    needed: dict[str, None] = {}

    def add(text: str) -> None:
        for name in _mentioned(text):
            if name not in needed:
                add(_VIEWS[name])
                needed[name] = None

    add(sql)
    if not needed:
        return sql.strip()
    named = ",\n".join(f"{name} AS ({_VIEWS[name].strip()})" for name in needed)
    return f"WITH {named}\n{sql.strip()}"


# The same result by another way.
_QUERIES |= {
    "append_trips_again": _QUERIES["append_trips"],
    "stored_service_hours": _QUERIES["trips_by_service_hours"],
    "stored_bike_locations": _QUERIES["daily_vehicle_kinds"],
    **{f"kept_{name}": _QUERIES[name] for name in r.KEPT},
}


def oracle_sql() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in _QUERIES.items()}
