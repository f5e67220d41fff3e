"""Date, time and timestamp functions (session time zone UTC)."""

from tessera.functions.spec import scalar

D, T = "cast(o_orderdate as date)", "cast(o_orderdate as timestamp)"
d, t = "o_orderdate::DATE", "o_orderdate::TIMESTAMP"
S = "unix_seconds(cast(o_orderdate as timestamp))"
s = "epoch(o_orderdate)::BIGINT"

scalar("orders", [
    *((n, f"{n}({D})", f"{n}({d})::INTEGER") for n in ("year", "quarter", "month", "weekofyear")),
    ("year_of_week", f"extract(YEAROFWEEK FROM {D})", f"isoyear({d})::INTEGER"), ("weekday", f"weekday({D})", f"(isodow({d}) - 1)::INTEGER"), ("dayofweek", f"dayofweek({D})", f"(dayofweek({d}) + 1)::INTEGER"), ("dayofmonth", f"dayofmonth({D})", f"day({d})::INTEGER"), ("dayofyear", f"dayofyear({D})", f"dayofyear({d})::INTEGER"),
    ("hour", "hour(timestamp_seconds(o_orderkey * 977))", "hour(to_timestamp(o_orderkey * 977) AT TIME ZONE 'UTC')::INTEGER"), ("minute", "minute(timestamp_seconds(o_orderkey * 977))", "minute(to_timestamp(o_orderkey * 977) AT TIME ZONE 'UTC')::INTEGER"), ("second", "second(timestamp_seconds(o_orderkey * 977))", "second(to_timestamp(o_orderkey * 977) AT TIME ZONE 'UTC')::INTEGER"),
    ("extract", f"extract(MONTH FROM {D})", f"month({d})::INTEGER"), ("from_unixtime", f"from_unixtime({S})", f"strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"), ("date_add", f"date_add({D}, 10)", f"({d} + 10)::DATE"), ("date_sub", f"date_sub({D}, 10)", f"({d} - 10)::DATE"),
    ("datediff", f"datediff({D}, date'1995-01-01')", f"({d} - DATE '1995-01-01')::INTEGER"), ("to_unix_timestamp", f"to_unix_timestamp({T})", s), ("unix_timestamp", f"unix_timestamp({T})", s), ("add_months", f"add_months({D}, 2)", f"({d} + INTERVAL 2 MONTH)::DATE"),
    ("date_format", f"date_format({D}, 'yyyy/MM/dd')", f"strftime({d}, '%Y/%m/%d')"), ("trunc", f"trunc({D}, 'MM')", f"date_trunc('month', {d})::DATE"), ("date_trunc", f"cast(date_trunc('YEAR', {T}) as date)", f"date_trunc('year', {d})::DATE"), ("get_timestamp", f"unix_seconds(to_timestamp(date_format({D}, 'yyyy-MM-dd'), 'yyyy-MM-dd'))", f"epoch({d})::BIGINT"),
    ("next_day", f"next_day({D}, 'MO')", f"({d} + (8 - isodow({d}))::INTEGER)::DATE"), ("last_day", f"last_day({D})", f"last_day({d})"), ("months_between", f"months_between(trunc({D}, 'MM'), date'1995-01-01')", f"datediff('month', DATE '1995-01-01', {d})::DOUBLE"),
    ("date_from_unix_date", f"date_from_unix_date(unix_date({D}))", d), ("unix_date", f"unix_date({D})", f"({d} - DATE '1970-01-01')::INTEGER"), ("make_date", f"make_date(year({D}), month({D}), 1)", f"make_date(year({d}), month({d}), 1)"), ("make_timestamp", f"unix_seconds(make_timestamp(year({D}), 1, 2, 3, 4, 5))", f"epoch(make_timestamp(year({d}), 1, 2, 3, 4, 5))::BIGINT"),
    ("make_ym_interval", f"cast({D} + make_ym_interval(1, 2) as date)", f"({d} + INTERVAL 14 MONTH)::DATE"), ("to_utc_timestamp", f"unix_seconds(to_utc_timestamp({T}, 'Asia/Tokyo'))", f"{s} - 32400"), ("from_utc_timestamp", f"unix_seconds(from_utc_timestamp({T}, 'Asia/Tokyo'))", f"{s} + 32400"),
    ("unix_seconds", S, s), ("unix_millis", f"unix_millis({T})", "epoch_ms(o_orderdate)"), ("unix_micros", f"unix_micros({T})", "epoch_us(o_orderdate)"), ("timestamp_seconds", "unix_seconds(timestamp_seconds(o_orderkey))", "o_orderkey"), ("timestamp_millis", "unix_millis(timestamp_millis(o_orderkey))", "o_orderkey"), ("timestamp_micros", "unix_micros(timestamp_micros(o_orderkey))", "o_orderkey"),
    ("timestampadd", f"unix_seconds(timestampadd(HOUR, 5, {T}))", f"{s} + 18000"), ("timestampdiff", f"timestampdiff(DAY, timestamp'1995-01-01', {T})", f"(({s} - epoch(TIMESTAMP '1995-01-01')) // 86400)::BIGINT"), ("floor_datetime", f"cast(date_trunc('WEEK', {T}) as date)", f"date_trunc('week', {d})::DATE"),
    ("cast_date_string", f"cast({D} as string)", f"strftime({d}, '%Y-%m-%d')"), ("to_date", f"to_date(date_format({D}, 'yyyyMMdd'), 'yyyyMMdd')", d), ("date_diff_weeks", f"datediff({D}, date'1995-01-01') div 7", f"(({d} - DATE '1995-01-01') // 7)::BIGINT"),
    ("partition_years", f"year({D}) - 1970", f"(year({d}) - 1970)::INTEGER"), ("partition_months", f"(year({D}) - 1970) * 12 + month({D}) - 1", f"((year({d}) - 1970) * 12 + month({d}) - 1)::INTEGER"), ("partition_days", f"unix_date({D})", f"({d} - DATE '1970-01-01')::INTEGER"), ("partition_hours", f"{S} div 3600", f"({s} // 3600)::BIGINT"),
    ("partition_bucket", "pmod(hash(o_custkey), 16)", ...), ("partition_truncate", "o_custkey - pmod(o_custkey, 100)", "o_custkey - o_custkey % 100"),
])
