"""Date and time functions over TIMESTAMP in a UTC session.

Names that Spark has with another meaning carry the prefix `chrono_` (text out as 2024-01-31T00:00:00Z) or `ts_`.
"""

from __future__ import annotations

from millrace.functions.registry import kernel, parse

CHRONO = parse("datetime", r"""
year = builtin ;; year(ts) ;; year(ts)
month = builtin ;; month(ts) ;; month(ts)
day = builtin ;; day(ts) ;; day(ts)
dayofmonth = builtin ;; dayofmonth(ts) ;; day(ts)
dayofyear = builtin ;; dayofyear(ts) ;; dayofyear(ts)
dayofweek = builtin ;; dayofweek(ts) ;; dayofweek(ts) + 1
weekofyear = builtin ;; weekofyear(ts) ;; weekofyear(ts)
quarter = builtin ;; quarter(ts) ;; quarter(ts)
hour = builtin ;; hour(ts) ;; hour(ts)
minute = builtin ;; minute(ts) ;; minute(ts)
second = builtin ;; second(ts) ;; second(ts)
iso_text(t TIMESTAMP) STRING = date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") ;; iso_text(ts) ;; strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
date_parse(s STRING) STRING = iso_text(try_to_timestamp(s)) ;; date_parse(CAST(ts AS STRING)) ;; strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
strftime_pattern(f STRING) STRING = replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(f, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'), '%B', 'MMMM'), '%b', 'MMM'), '%A', 'EEEE'), '%y', 'yy'), '%j', 'DDD')
chrono_date_format(t TIMESTAMP, f STRING) STRING = date_format(t, strftime_pattern(f)) ;; chrono_date_format(ts, '%Y/%m/%d %H') ;; strftime(ts, '%Y/%m/%d %H')
to_char_text(t TIMESTAMP, f STRING) STRING = date_format(t, strftime_pattern(f)) ;; to_char_text(ts, '%Y-%m') ;; strftime(ts, '%Y-%m')
str_to_date(s STRING, f STRING) TIMESTAMP = to_timestamp(s, strftime_pattern(f)) ;; str_to_date(date_format(ts, 'yyyy-MM-dd'), '%Y-%m-%d') ;; date_trunc('day', ts)
unit_name(u STRING) STRING = rtrim('s', lower(u))
chrono_add(t TIMESTAMP, n INT, u STRING) TIMESTAMP = CASE unit_name(u) WHEN 'second' THEN timestampadd(SECOND, n, t) WHEN 'minute' THEN timestampadd(MINUTE, n, t) WHEN 'hour' THEN timestampadd(HOUR, n, t) WHEN 'day' THEN timestampadd(DAY, n, t) WHEN 'week' THEN timestampadd(WEEK, n, t) WHEN 'month' THEN timestampadd(MONTH, n, t) WHEN 'quarter' THEN timestampadd(MONTH, 3 * n, t) WHEN 'year' THEN timestampadd(YEAR, n, t) END ;; chrono_add(ts, 1, 'months') ;; ts + INTERVAL 1 MONTH
chrono_sub(t TIMESTAMP, n INT, u STRING) TIMESTAMP = chrono_add(t, -n, u) ;; chrono_sub(ts, 2, 'hours') ;; ts - INTERVAL 2 HOUR
adddate(t TIMESTAMP, n INT) TIMESTAMP = timestampadd(DAY, n, t) ;; adddate(ts, 3) ;; ts + INTERVAL 3 DAY
subdate(t TIMESTAMP, n INT) TIMESTAMP = timestampadd(DAY, -n, t) ;; subdate(ts, 3) ;; ts - INTERVAL 3 DAY
chrono_months_between(a TIMESTAMP, b TIMESTAMP) BIGINT = CAST((year(a) - year(b)) * 12 + month(a) - month(b) + CASE WHEN a >= b AND day(a) < day(b) THEN -1 WHEN a < b AND day(a) > day(b) THEN 1 ELSE 0 END AS BIGINT)
chrono_diff(a TIMESTAMP, b TIMESTAMP, u STRING) BIGINT = CASE unit_name(u) WHEN 'second' THEN (unix_micros(a) - unix_micros(b)) div 1000000 WHEN 'minute' THEN (unix_micros(a) - unix_micros(b)) div 60000000 WHEN 'hour' THEN (unix_micros(a) - unix_micros(b)) div 3600000000 WHEN 'day' THEN (unix_micros(a) - unix_micros(b)) div 86400000000 WHEN 'week' THEN (unix_micros(a) - unix_micros(b)) div 604800000000 WHEN 'month' THEN chrono_months_between(a, b) WHEN 'quarter' THEN chrono_months_between(a, b) div 3 WHEN 'year' THEN chrono_months_between(a, b) div 12 END ;; chrono_diff(ts, TIMESTAMP'2024-01-01 00:00:00', 'days') ;; CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) // 86400000000
chrono_tz(t TIMESTAMP, a STRING, b STRING) STRING = iso_text(from_utc_timestamp(to_utc_timestamp(t, a), b)) ;; chrono_tz(ts, 'UTC', 'Asia/Tokyo') ;; strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ')
date_is_business_day(t TIMESTAMP) INT = CAST(weekday(t) < 5 AS INT) ;; date_is_business_day(ts) ;; CAST(isodow(ts) < 6 AS INTEGER)
weekdays_before(d DATE) BIGINT = (datediff(d, DATE'1970-01-05') - pmod(datediff(d, DATE'1970-01-05'), 7)) div 7 * 5L + least(pmod(datediff(d, DATE'1970-01-05'), 7), 5)
business_days_between(a TIMESTAMP, b TIMESTAMP) BIGINT = weekdays_before(to_date(b)) - weekdays_before(to_date(a)) ;; business_days_between(TIMESTAMP'2024-01-01 00:00:00', ts) ;; (SELECT count(*) FROM generate_series(0, date_diff('day', DATE '2024-01-01', ts::DATE) - 1) AS g(i) WHERE isodow(DATE '2024-01-01' + CAST(i AS INTEGER)) < 6)
iso_year(t TIMESTAMP) INT = extract(YEAROFWEEK FROM t) ;; iso_year(ts) ;; CAST(isoyear(ts) AS INTEGER)
iso_week(t TIMESTAMP) INT = weekofyear(t) ;; iso_week(ts) ;; CAST(weekofyear(ts) AS INTEGER)
iso_weekday(t TIMESTAMP) INT = weekday(t) + 1 ;; iso_weekday(ts) ;; CAST(isodow(ts) AS INTEGER)
month_name(t TIMESTAMP) STRING = date_format(t, 'MMMM') ;; month_name(ts) ;; monthname(ts)
weekday_name(t TIMESTAMP) STRING = date_format(t, 'EEEE') ;; weekday_name(ts) ;; dayname(ts)
fiscal_year(t TIMESTAMP, start INT) INT = year(t) - CAST(month(t) < start AS INT) ;; fiscal_year(ts, 4) ;; CAST(year(ts) - CASE WHEN month(ts) < 4 THEN 1 ELSE 0 END AS INTEGER)
fiscal_quarter(t TIMESTAMP, start INT) INT = CAST(pmod(month(t) - start, 12) div 3 + 1 AS INT) ;; fiscal_quarter(ts, 4) ;; CAST(((month(ts) + 8) % 12) // 3 + 1 AS INTEGER)
chrono_extract(f STRING, t TIMESTAMP) DOUBLE = CAST(CASE lower(f) WHEN 'year' THEN year(t) WHEN 'quarter' THEN quarter(t) WHEN 'month' THEN month(t) WHEN 'week' THEN weekofyear(t) WHEN 'day' THEN day(t) WHEN 'dow' THEN dayofweek(t) WHEN 'doy' THEN dayofyear(t) WHEN 'hour' THEN hour(t) WHEN 'minute' THEN minute(t) WHEN 'second' THEN second(t) WHEN 'epoch' THEN unix_seconds(t) END AS DOUBLE) ;; chrono_extract('doy', ts) ;; CAST(dayofyear(ts) AS DOUBLE)
last_day_text(t TIMESTAMP) STRING = iso_text(CAST(last_day(t) AS TIMESTAMP)) ;; last_day_text(ts) ;; strftime(last_day(ts), '%Y-%m-%dT00:00:00Z')
from_unix(n BIGINT) STRING = iso_text(timestamp_seconds(n)) ;; from_unix(event_id) ;; strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%SZ')
to_days(t TIMESTAMP) BIGINT = datediff(to_date(t), DATE'0000-01-01') + 0L
from_days(n BIGINT) DATE = date_add(DATE'0000-01-01', int(n))
epoch(t TIMESTAMP) DOUBLE = unix_micros(t) / 1e6 ;; round(epoch(ts), 3) ;; round(epoch(ts), 3)
epoch_ms(t TIMESTAMP) BIGINT = unix_millis(t) ;; epoch_ms(ts) ;; epoch_us(ts) // 1000
epoch_us(t TIMESTAMP) BIGINT = unix_micros(t) ;; epoch_us(ts) ;; epoch_us(ts)
unix_seconds = builtin ;; unix_seconds(timestamp(ts)) ;; CAST(floor(epoch(ts)) AS BIGINT)
unix_millis = builtin ;; unix_millis(timestamp(ts)) ;; epoch_us(ts) // 1000
unix_micros = builtin ;; unix_micros(timestamp(ts)) ;; epoch_us(ts)
date_trunc = builtin ;; date_trunc('week', ts) ;; CAST(date_trunc('week', ts) AS TIMESTAMP)
make_date = builtin ;; make_date(year(ts), month(ts), 1) ;; make_date(year(ts), month(ts), 1)
timestamp_trunc(t TIMESTAMP, u STRING) TIMESTAMP = date_trunc(u, t) ;; timestamp_trunc(ts, 'hour') ;; CAST(date_trunc('hour', ts) AS TIMESTAMP)
chrono_time_bucket(seconds BIGINT, t TIMESTAMP) TIMESTAMP = timestamp_seconds(unix_seconds(t) div seconds * seconds) ;; chrono_time_bucket(3600, ts) ;; CAST(date_trunc('hour', ts) AS TIMESTAMP)
interval_seconds(i STRING) BIGINT = CAST(coalesce(regexp_extract(i, '^\\s*([0-9]+)', 1), '1') AS BIGINT) * CASE unit_name(regexp_extract(i, '([A-Za-z]+)\\s*$', 1)) WHEN 'second' THEN 1L WHEN 'minute' THEN 60L WHEN 'hour' THEN 3600L WHEN 'day' THEN 86400L WHEN 'week' THEN 604800L END
interval_months(i STRING) BIGINT = CAST(regexp_extract(i, '^\\s*([0-9]+)', 1) AS BIGINT) * CASE unit_name(regexp_extract(i, '([A-Za-z]+)\\s*$', 1)) WHEN 'month' THEN 1L WHEN 'quarter' THEN 3L WHEN 'year' THEN 12L END
ts_bucket(t TIMESTAMP, i STRING) TIMESTAMP = if(interval_months(i) IS NOT NULL, CAST(add_months(DATE'1970-01-01', int(((year(t) - 1970) * 12 + month(t) - 1 - pmod((year(t) - 1970) * 12 + month(t) - 1, interval_months(i))))) AS TIMESTAMP), timestamp_seconds(unix_seconds(t) - pmod(unix_seconds(t), interval_seconds(i)))) ;; ts_bucket(ts, '15 minutes') ;; time_bucket(INTERVAL 15 MINUTE, ts)
duration_format(n BIGINT) STRING = if(n = 0, '0s', concat(if(n < 0, '-', ''), concat_ws(' ', if(abs(n) >= 86400, concat(abs(n) div 86400, 'd'), NULL), if(abs(n) % 86400 >= 3600, concat(abs(n) % 86400 div 3600, 'h'), NULL), if(abs(n) % 3600 >= 60, concat(abs(n) % 3600 div 60, 'm'), NULL), if(abs(n) % 60 > 0, concat(abs(n) % 60, 's'), NULL))))
chrono_age(a TIMESTAMP, b TIMESTAMP) STRING = duration_format(unix_seconds(a) - unix_seconds(b))
duration_humanize(n BIGINT) STRING = CASE WHEN abs(n) < 60 THEN concat(n, ' seconds') WHEN abs(n) < 3600 THEN concat(n div 60, ' minutes') WHEN abs(n) < 86400 THEN concat(n div 3600, ' hours') ELSE concat(n div 86400, ' days') END
time_humanize(t BIGINT, now BIGINT) STRING = if(t <= now, concat(duration_humanize(now - t), ' ago'), concat('in ', duration_humanize(t - now)))
""")


def duration(text: str) -> int | None:
    """Seconds of `1d 3h`, `90m`, `PT1H30M`, `1:30:00` or a plain number; None if it is none of these."""
    import re

    t = text.strip()
    if re.fullmatch(r"-?\d+", t):
        return int(t)
    if m := re.fullmatch(r"(?:(\d+):)?(\d+):(\d+)", t):
        return int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])
    if m := re.fullmatch(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", t, re.I):
        return sum(int(x or 0) * k for x, k in zip(m.groups(), (604800, 86400, 3600, 60, 1), strict=True))
    units = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}
    parts = re.findall(r"(\d+)\s*([a-z]+)", t.lower())
    if not parts or re.sub(r"\d+\s*[a-z]+|[\s,]+", "", t.lower()) or any(u[0] not in units for _, u in parts):
        return None
    return sum(int(n) * units[u[0]] for n, u in parts)


def cron_next(expression: str, after: str) -> str | None:
    """The first minute after a time that the five fields match, as ISO text; None if there is none in five years."""
    from datetime import datetime, timedelta

    fields = expression.split()
    if len(fields) != 5:
        return None
    sets = []
    for field, (low, high) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6)), strict=True):
        got: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
            got.update(range(first, last + 1, int(step or 1)))
        sets.append({x % 7 for x in got} if (low, high) == (0, 6) else got)
    t = datetime.fromisoformat(after.replace("Z", "")).replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = t + timedelta(days=5 * 366)
    while t < end:
        on_day, on_week = t.day in sets[2], (t.weekday() + 1) % 7 in sets[4]
        either = on_day or on_week if fields[2] != "*" and fields[4] != "*" else on_day and on_week
        if t.month not in sets[3] or not either:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
        elif t.hour not in sets[1]:
            t = (t + timedelta(hours=1)).replace(minute=0)
        elif t.minute not in sets[0]:
            t += timedelta(minutes=1)
        else:
            return t.strftime("%Y-%m-%dT%H:%M:%SZ")
    return None


FUNCTIONS = [*CHRONO, kernel("datetime", "duration_parse", "long", duration), kernel("datetime", "cron_next", "string", cron_next)]
