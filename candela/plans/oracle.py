"""The same queries in SQL, from the same tables: one chain of common table expressions, and a last select for each."""

from __future__ import annotations

import re

from candela.functions.hashes import TTL, TTL_EMPTY, TTL_OTHER
from candela.functions.text import ACCENTED, PLAIN, REDACT_PATTERNS, REDACTED, SYMBOL_TAGS
from candela.operators.pages import CONFLUENCE_WIDTHS, HEADS, ZONE_WIDTHS
from candela.schema import CONFLUENCE_THRESHOLDS, FOREX_BASES, PROFILES, STATUSES, TF_LAMBDA, TF_PEAK_DISTANCE, TF_TREND, TF_WEIGHT, TIMEFRAMES, UI_CONFLUENCE_THRESHOLD, UI_MIN_TOUCHES


def text(value) -> str:
    if value is None:
        return "null"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)


def case(column: str, values: dict, default) -> str:
    return "case " + column + "".join(f" when {text(k)} then {text(v)}" for k, v in values.items()) + f" else {text(default)} end"


def q(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def half_even(x: str, digits: int) -> str:
    """A column rounded by its exact binary value: its product with the scale is taken in two exact halves."""
    k, head, scale = f"round_even({x} * 1e{digits}, 0)", f"({x} * 134217729.0::double - ({x} * 134217729.0::double - {x}))", f"2e{digits}"
    beyond = lambda middle: f"(({head} * {scale} - ({middle})) + ({x} - {head}) * {scale})"
    above, below, odd = beyond(f"2 * {k} + 1"), beyond(f"2 * {k} - 1"), f"abs({k}) % 2 = 1"
    return f"(case when {above} > 0 or ({above} = 0 and {odd}) then {k} + 1 when {below} < 0 or ({below} = 0 and {odd}) then {k} - 1 else {k} end / 1e{digits})"


PROFILE_COLUMNS = (
    "profile_key, asset_class, cluster_radius_atr, merge_threshold_atr, pivot_prominence_atr, skip_ratio_check, wick_intraday, wick_htf,"
    " confluence_threshold_pct, max_live_vs_close_pct, pdf_max_dist_pct, price_min, price_max, min_touches_h4, min_touches_daily, min_touches_weekly, ignore_wick_filter,"
    " major_pivot_mult, max_high_low_ratio, max_cluster_width_pct"
)
EXACT = ", ".join(text(p[0]) for p in PROFILES if p[0][0] != "*" and p[0] != "DEFAULT")
KEY = (
    "case when trim(replace(upper(symbol), '/', '_')) in ({e}) then trim(replace(upper(symbol), '/', '_'))"
    " when string_split(trim(replace(upper(symbol), '/', '_')), '_')[2] = 'JPY' then '*JPY'"
    " when string_split(trim(replace(upper(symbol), '/', '_')), '_')[1] in ({b}) then '*BASE' else 'DEFAULT' end"
).format(e=EXACT, b=", ".join(map(text, FOREX_BASES)))
MIN_TOUCHES = f"""case when asset_class in ('INDEX', 'METAL') or ends_with(symbol, '_JPY') then {{p}} else greatest({{p}}, {UI_MIN_TOUCHES}) end""".format(
    p="case tf when 'H4' then min_touches_h4 when 'Daily' then min_touches_daily when 'Weekly' then min_touches_weekly else 2 end"
)
SEVERITY = case("status", {s: i for i, s in enumerate(STATUSES)}, 1)
STATUS = case("severity", dict(enumerate(STATUSES)), None)
REACH = "case when tf = 'Weekly' then 5 else 3 end"
BAR_SQL = "symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {0} as open, {1} as high, {2} as low, {3} as close, volume::bigint as volume".format(*map(q, ("open", "high", "low", "close")))


def swing(n: int) -> str:
    return f"""
  select *, {n} as reach,
    max(high) over (w rows between {n} preceding and 1 preceding) as hl, max(high) over (w rows between 1 following and {n} following) as hr,
    min(low) over (w rows between {n} preceding and 1 preceding) as ll, min(low) over (w rows between 1 following and {n} following) as lr,
    max(high) over (w rows between {n} preceding and {n} following) as ha, min(low) over (w rows between {n} preceding and {n} following) as la
  from bars where {REACH} = {n} window w as (partition by symbol, tf order by bar_idx)"""


def levels(side: str) -> str:
    support = side == "Support"
    s, price, wrong, part = (-1, "low", ">=", 0.10) if support else (1, "high", "<=", 0.90)
    return f"""
  select * from (
    select symbol, tf, mult, case when raw {wrong} price then price * (1.0 + {s * 0.004} * mult) else raw end as level, floor(mult * 10 + 5)::int as strength, '{side}' as zone_type, price, atr, asset_class
    from (select *, exp(last_fit + anchor + {s} * mult * band) as raw from (
      select f.*, c.price, c.atr, c.asset_class, case when std > 0 then std when abs(anchor) > 0 then abs(anchor) else c.atr / greatest(c.price, 1e-9) end as band
      from (select symbol, tf, quantile_cont(ln({price}) - fitted, {part}) as anchor, stddev_pop(ln({price}) - fitted) as std, arg_max(fitted, bar_idx) as last_fit from log_fit group by symbol, tf) f
      join usable c using (symbol, tf)) x, (select unnest([1.0::double, 2.0::double]) as mult) m) y where raw > 0) z
  where {s} * (level - price) > 0 and {s} * (level - price) / price * 100 <= case when asset_class = 'INDEX' then 15.0 else 8.0 end"""


# name -> body; all are put before each final select, so that a stage is written once
STAGES = {
    "profiles": f"select * from (values {', '.join('(' + ', '.join(map(text, p)) + ')' for p in PROFILES)}) t({PROFILE_COLUMNS})",
    "trades": """
  select case l_returnflag when 'A' then 'EUR_USD' when 'N' then 'USD_JPY' else 'XAU_USD' end as symbol, l_shipdate + to_hours((((l_linenumber - 1) % 6) * 4)::int) as ts,
    round(l_extendedprice * 100)::bigint % 201 - 100 as step, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem""",
    "ticks": """
  select symbol, ts, row_number() over w as place, (100.0 + (sum(step) over (w rows unbounded preceding))::bigint / 1000.0) * case when symbol = 'XAU_USD' then 20.0 else 1.0 end as price
  from trades window w as (partition by symbol order by ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)""",
    "h4": """
  select symbol, 'H4' as tf, time_bucket(interval 4 hours, ts) as start, arg_min(price, place) as open, max(price) as high, min(price) as low, arg_max(price, place) as close, count(*) as volume
  from ticks group by symbol, start""",
    "long_bars": """
  select symbol, 'H4' as tf, start as ts, open, high, low, close, volume from h4
  union all select symbol, 'Daily', date_trunc('day', start), arg_min(open, start), max(high), min(low), arg_max(close, start), sum(volume) from h4 group by symbol, date_trunc('day', start)
  union all select symbol, 'Weekly', date_trunc('week', start), arg_min(open, start), max(high), min(low), arg_max(close, start), sum(volume) from h4 group by symbol, date_trunc('week', start)""",
    "bars": """
  select *, (row_number() over (partition by symbol, tf order by ts) - 1)::int as bar_idx, (count(*) over (partition by symbol, tf))::int as n_bars from (
    select * from long_bars where low > 0 and high >= low and open between low and high and close between low and high and high / low <= case when symbol = 'XAU_USD' then 2.5 else 1.8 end
    qualify row_number() over (partition by symbol, tf order by ts desc) <= 500)""",
    "ranges": """
  select *, case when previous is null then high - low else greatest(high - low, abs(high - previous), abs(low - previous)) end as true_range
  from (select *, lag(close) over (partition by symbol, tf order by bar_idx) as previous from bars)""",
    "atrs": """
  select symbol, tf, n_bars, last_close, case when v > 0 then v end as atr from (
    select symbol, tf, n_bars, arg_max(close, bar_idx) as last_close, case when n_bars > 14 then avg(true_range) filter (bar_idx >= n_bars - 14) when n_bars >= 2 then avg(high - low) end as v
    from ranges group by symbol, tf, n_bars)""",
    "symbols": "select unnest(['EUR_USD', 'USD_JPY', 'XAU_USD', 'GBP_USD', 'NAS100_USD']) as symbol",
    "quotes": """
  select symbol, arg_max(close, ts) * 1.001 as quote, case when symbol = 'EUR_USD' then 'live' else 'stale' end as quoted from long_bars where tf = 'Daily' and symbol in ('EUR_USD', 'USD_JPY') group by symbol""",
    "closes": """
  select symbol, arg_max(close, ts) filter (tf = 'Daily') as d, arg_max(close, ts) filter (tf = 'H4') as h, arg_max(close, ts) filter (tf = 'Weekly') as w from bars group by symbol""",
    "working": """
  select symbol, coalesce(quote, d, h, w) as raw_price, quote is null and coalesce(d, h, w) is not null as is_fallback,
    case when quote is not null then quoted when coalesce(d, h, w) is not null then 'candle_close' end as source, d as daily_close
  from symbols left join quotes using (symbol) left join closes using (symbol)""",
    "bounded": """
  select *, case when price_error is not null then null when raw_price < price_min then price_min when raw_price > price_max then price_max else raw_price end as price from (
    select w.*, p.price_min, p.price_max, p.max_live_vs_close_pct, p.skip_ratio_check, case when raw_price is null then 'Aucune donnee disponible'
      when raw_price < price_min / 10.0 then printf('PRIX CORROMPU (%.2f << %.0f)', raw_price, price_min)
      when raw_price > price_max * 10.0 then printf('PRIX CORROMPU (%.2f >> %.0f)', raw_price, price_max) end as price_error
    from {working} w join profiles p on p.profile_key = """ + KEY + ")",
    "usable": f"""
  select a.symbol, a.tf, a.n_bars, a.last_close, a.atr, b.price, p.*, {MIN_TOUCHES.replace('symbol', 'a.symbol').replace('case tf', 'case a.tf')} as min_touches
  from atrs a join bounded b using (symbol) join profiles p on p.profile_key = {KEY.replace('symbol', 'a.symbol')} where atr > 0 and price > 0""",
    "trend_rows": f"""
  select *, close / first_value(close) over (partition by symbol, tf order by bar_idx) as y from (
    select *, {case('tf', {k: v[0] for k, v in TF_TREND.items()}, 20)} as look, bar_idx - (n_bars - {case('tf', {k: v[0] for k, v in TF_TREND.items()}, 20)}) as x from bars)
  where x >= 0""",
    "trends": f"""
  select symbol, tf, any_value(case when n_bars >= look then slope end) as slope, case when any_value(n_bars) < any_value(look) then 'NEUTRE'
      when stddev_samp(y - (slope * x + intercept)) > 0 and any_value(slope) / (stddev_samp(y - (slope * x + intercept)) / sqrt(count(*))) > {case('tf', {k: v[1] for k, v in TF_TREND.items()}, 2.0)} then 'HAUSSIER'
      when stddev_samp(y - (slope * x + intercept)) > 0 and any_value(slope) / (stddev_samp(y - (slope * x + intercept)) / sqrt(count(*))) < -{case('tf', {k: v[1] for k, v in TF_TREND.items()}, 2.0)} then 'BAISSIER'
      else 'NEUTRE' end as trend
  from trend_rows join (select symbol, tf, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from trend_rows group by symbol, tf) f using (symbol, tf) group by symbol, tf""",
    "log_rows": "select *, bar_idx - greatest(n_bars - 100, 0) as x, ln(close) as y from bars where n_bars >= 30 and bar_idx >= n_bars - 100",
    "log_fit": """
  select r.*, slope, intercept, slope * x + intercept as fitted from log_rows r join (select symbol, tf, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from log_rows group by symbol, tf) f using (symbol, tf)""",
    "support_levels": levels("Support"),
    "resistance_levels": levels("Resistance"),
    "trend_zones": """
  select * from (select * from support_levels union all select * from resistance_levels) qualify row_number() over (partition by symbol, tf, zone_type, floor(level * 1e5 + 0.5) order by mult) = 1""",
    "swings": f"""
  select *, bar_idx >= reach and bar_idx < n_bars - reach and high > hl and high > hr as is_high, bar_idx >= reach and bar_idx < n_bars - reach and low < ll and low < lr as is_low,
    (high - greatest(open, close)) / greatest(high - low, 1e-10) as upper_wick, (least(open, close) - low) / greatest(high - low, 1e-10) as lower_wick, high - la as high_prominence, ha - low as low_prominence
  from ({swing(3)} union all {swing(5)})""",
    "limits": """
  select *, least(atr * pivot_prominence_atr, last_close * case when asset_class in ('INDEX', 'METAL') then 0.012 else 0.008 end) as full_floor,
    least(atr * pivot_prominence_atr * 0.5, last_close * case when asset_class in ('INDEX', 'METAL') then 0.012 else 0.008 end) as half_floor from usable""",
    "candidates": """
  select symbol, tf, kind, bar_idx, price, 0.35 + 0.65 * (bar_idx / (n_bars - 1)) as weight, prominence, prominence >= full_floor as full_, prominence >= half_floor as half from (
    select s.symbol, s.tf, 'high' as kind, bar_idx, high as price, s.n_bars, high_prominence as prominence, full_floor, half_floor from swings s join limits l using (symbol, tf)
      where is_high and s.n_bars >= 15 and (ignore_wick_filter or upper_wick >= case when s.tf = 'H4' then wick_intraday else wick_htf end)
    union all
    select s.symbol, s.tf, 'low', bar_idx, low, s.n_bars, low_prominence, full_floor, half_floor from swings s join limits l using (symbol, tf)
      where is_low and s.n_bars >= 15 and (ignore_wick_filter or lower_wick >= case when s.tf = 'H4' then wick_intraday else wick_htf end))""",
    "tiered": """
  select * from (select *, case when n_full >= 3 or n_half <= n_full then 'full' else 'half' end as tier from (
    select *, count(*) filter (full_) over (partition by symbol, tf) as n_full, count(*) filter (half) over (partition by symbol, tf) as n_half from candidates))
  where case when tier = 'full' then full_ else half end""",
    "poor": "select symbol, tf, atr, half_floor as least_ from limits where (symbol, tf) not in (select (symbol, tf) from tiered group by symbol, tf having count(*) >= 3)",
    "points": f"""
  select *, case when reach = 5 then lt5 else lt3 end as left_top, case when reach = 5 then rt5 else rt3 end as right_top, case when reach = 5 then ll5 else ll3 end as left_low, case when reach = 5 then rl5 else rl3 end as right_low from (
    select *, {REACH} as reach,
      max(x) over (w rows between 3 preceding and 1 preceding) as lt3, max(x) over (w rows between 1 following and 3 following) as rt3, min(x) over (w rows between 3 preceding and 1 preceding) as ll3, min(x) over (w rows between 1 following and 3 following) as rl3,
      max(x) over (w rows between 5 preceding and 1 preceding) as lt5, max(x) over (w rows between 1 following and 5 following) as rt5, min(x) over (w rows between 5 preceding and 1 preceding) as ll5, min(x) over (w rows between 1 following and 5 following) as rl5
    from (select symbol, tf, bar_idx, n_bars, 'high' as kind, high as x from bars semi join poor using (symbol, tf) union all select symbol, tf, bar_idx, n_bars, 'low', -low from bars semi join poor using (symbol, tf))
    window w as (partition by symbol, tf, kind order by bar_idx))""",
    "tops": f"""
  select symbol, tf, kind, ((first_ + last_) // 2)::int as bar_idx, {case('tf', TF_PEAK_DISTANCE, 5)} as distance, row_number() over (partition by symbol, tf, kind order by x desc, first_ desc) as rn from (
    select *, lag(x) over w as before_, lead(x) over w as after_ from (
      select symbol, tf, kind, flat, any_value(x) as x, min(bar_idx) as first_, max(bar_idx) as last_ from (
        select *, sum(case when x <> previous then 1 else 0 end) over (partition by symbol, tf, kind order by bar_idx rows unbounded preceding) as flat
        from (select *, lag(x) over (partition by symbol, tf, kind order by bar_idx) as previous from points)) group by symbol, tf, kind, flat) window w as (partition by symbol, tf, kind order by flat))
  where before_ < x and after_ < x""",
    "spacing": """
  select symbol, tf, kind, rn, [bar_idx] as kept from tops where rn = 1
  union all
  select t.symbol, t.tf, t.kind, t.rn, case when len(list_filter(s.kept, lambda k: abs(k - t.bar_idx) < t.distance)) > 0 then s.kept else list_append(s.kept, t.bar_idx) end
  from spacing s join tops t on t.symbol = s.symbol and t.tf = s.tf and t.kind = s.kind and t.rn = s.rn + 1""",
    "extra": """
  select symbol, tf, kind, bar_idx, abs(x) as price, case when n_bars <= 1 then 1.0 else 0.35 + 0.65 * (bar_idx / (n_bars - 1)) end as weight, x - greatest(left_low, right_low) as prominence
  from points join (select symbol, tf, kind, unnest(kept) as bar_idx from (select symbol, tf, kind, arg_max(kept, rn) as kept from spacing group by symbol, tf, kind)) k using (symbol, tf, kind, bar_idx) join poor using (symbol, tf)
  where bar_idx >= reach and bar_idx < n_bars - reach and x > left_top and x > right_top and x - greatest(left_low, right_low) >= least_""",
    "pivots_": """
  select symbol, tf, kind, bar_idx, price, weight, prominence from (select symbol, tf, kind, bar_idx, price, weight, prominence, 0 as origin from tiered union all select *, 1 from extra)
  qualify row_number() over (partition by symbol, tf, bar_idx, kind order by prominence desc, origin) = 1""",
    "ordered": """
  select t.*, row_number() over (partition by symbol, tf, kind order by t.price, bar_idx, weight, prominence) as rn,
    least(greatest(atr * cluster_radius_atr, u.price * 0.0015), u.price * (max_cluster_width_pct / 100.0)) as band from pivots_ t join usable u using (symbol, tf)""",
    "clusters": """
  select symbol, tf, kind, bar_idx, price, weight, prominence, rn, 1 as cluster_id, price as first_price from ordered where rn = 1
  union all
  select o.symbol, o.tf, o.kind, o.bar_idx, o.price, o.weight, o.prominence, o.rn,
    case when o.price - c.price > band or o.price - c.first_price > 2.5 * band then c.cluster_id + 1 else c.cluster_id end,
    case when o.price - c.price > band or o.price - c.first_price > 2.5 * band then o.price else c.first_price end
  from clusters c join ordered o on o.symbol = c.symbol and o.tf = c.tf and o.kind = c.kind and o.rn = c.rn + 1""",
    "metrics": """
  select symbol, tf, kind, cluster_id, sum(price * weight) / sum(weight) as level, sum(prominence * weight) / sum(weight) as prominence, max(prominence) as max_prominence,
    count(distinct bar_idx)::int as touches, max(bar_idx) as last_idx, count(*) as n_pivots from clusters group by symbol, tf, kind, cluster_id""",
    "raw_zones": """
  select * from (
    select m.symbol, m.tf, case when kind = 'high' then 'Resistance' else 'Support' end as zone_type, level, touches as strength, greatest(0, n_bars - 1 - last_idx) as age_bars, last_idx, prominence,
      prominence / atr as prominence_atr, touches = 1 and max_prominence >= atr * major_pivot_mult as is_major, atr, min_touches from metrics m join usable u using (symbol, tf))
  where (strength >= min_touches or is_major) and level > 0""",
    "flags": """
  select z.*, b.bar_idx,
    case when zone_type = 'Support' then b.low <= level + tol and b.close > level - tol else b.high >= level - tol and b.close < level + tol end as tested,
    case when zone_type = 'Support' then b.close < level - tol else b.close > level + tol end as broke,
    b.low <= level + tol * 2 and b.high >= level - tol * 2 as near,
    case when zone_type = 'Support' then b.close > level + tol else b.close < level - tol end as undone
  from (select *, atr * 0.25 as tol from raw_zones) z join bars b on z.symbol = b.symbol and z.tf = b.tf and b.bar_idx > z.last_idx""",
    "breaks": "select symbol, tf, zone_type, level, last_idx, max(tested::int) as tested, min(bar_idx) filter (broke) as break_idx from flags group by symbol, tf, zone_type, level, last_idx",
    "retests": """
  select b.symbol, b.tf, b.zone_type, b.level, b.last_idx, any_value(b.tested) as tested, any_value(b.break_idx) as break_idx, min(f.bar_idx) filter (near and f.bar_idx > b.break_idx) as retest_idx
  from breaks b join flags f using (symbol, tf, zone_type, level, last_idx) group by b.symbol, b.tf, b.zone_type, b.level, b.last_idx""",
    "staged": """
  select z.*, r.tested, r.break_idx, r.retest_idx, r.undone from raw_zones z left join (
    select r.symbol, r.tf, r.zone_type, r.level, r.last_idx, any_value(r.tested) as tested, any_value(r.break_idx) as break_idx, any_value(r.retest_idx) as retest_idx,
      coalesce(max(f.undone::int) filter (f.bar_idx > r.retest_idx), 0) as undone
    from retests r join flags f using (symbol, tf, zone_type, level, last_idx) group by r.symbol, r.tf, r.zone_type, r.level, r.last_idx) r using (symbol, tf, zone_type, level, last_idx)""",
    "statused": """
  select *, case when break_idx is null then case when tested = 1 then 'Testee' else 'Vierge' end when retest_idx is null or undone = 1 then 'Consommee' else 'Role Reverse' end as status from staged""",
    "to_merge": f"""
  select *, row_number() over (partition by symbol, tf, zone_type order by level, age_bars, strength, severity, prominence, prominence_atr, is_major) as rn from (
    select z.*, least(u.atr * merge_threshold_atr, u.price * 0.0075) as reach, {SEVERITY} as severity from (
      select symbol, tf, zone_type, level, strength, age_bars, status, prominence, prominence_atr, is_major from statused
      union all select symbol, tf, zone_type, level, strength, 0, 'Vierge', abs(price - level), abs(price - level) / atr, true from trend_zones where asset_class in ('INDEX', 'METAL')) z
    join usable u using (symbol, tf) where status <> 'Consommee')""",
    "merging": """
  select symbol, tf, zone_type, rn, 1 as zone_id, level, strength, age_bars, severity, prominence, prominence_atr, is_major from to_merge where rn = 1
  union all
  select z.symbol, z.tf, z.zone_type, z.rn, case when j then p.zone_id else p.zone_id + 1 end, case when j then (p.level * p.strength + z.level * z.strength) / (p.strength + z.strength) else z.level end,
    case when j then p.strength + z.strength else z.strength end, case when j then least(p.age_bars, z.age_bars) else z.age_bars end, case when j then greatest(p.severity, z.severity) else z.severity end,
    case when j then greatest(p.prominence, z.prominence) else z.prominence end, case when j then greatest(p.prominence_atr, z.prominence_atr) else z.prominence_atr end, case when j then p.is_major or z.is_major else z.is_major end
  from merging p join to_merge z on z.symbol = p.symbol and z.tf = p.tf and z.zone_type = p.zone_type and z.rn = p.rn + 1, lateral (select z.reach > 0 and abs(z.level - p.level) <= z.reach as j) x""",
    "merged": f"select *, {STATUS} as status from merging qualify row_number() over (partition by symbol, tf, zone_type, zone_id order by rn desc) = 1",
    "typed": """
  select m.symbol, m.tf, m.level, m.strength, m.age_bars, m.status, m.severity, m.is_major, u.price, u.atr, u.n_bars, u.pdf_max_dist_pct,
    case when (zone_type = 'Resistance' and level < u.price) or (zone_type = 'Support' and level >= u.price) then 'Pivot' else zone_type end as zone_type from merged m join usable u using (symbol, tf)""",
    "zones": """
  select *, abs(level - price) / price * 100 <= 0.50 as near_price from (select *, case when level < price then 'Support' else 'Resistance' end as side from typed) where zone_type = side or zone_type = 'Pivot'""",
    "islands": f"""
  select *, (sum(gap) over (partition by symbol order by level, tf, side, age_bars rows unbounded preceding))::int as island from (
    select *, case when (level - lag(level) over w) / lag(level) over w * 100 <= {case('symbol', CONFLUENCE_THRESHOLDS, UI_CONFLUENCE_THRESHOLD)} then 0 else 1 end as gap
    from zones where status <> 'Consommee' window w as (partition by symbol order by level, tf, side, age_bars))""",
    "kept": "select * from islands join (select symbol, island from islands group by symbol, island having count(distinct tf) >= 2 or bool_or(is_major)) k using (symbol, island)",
    "nearest": """
  select * from (select *, abs(level - avg(level) over (partition by symbol, island)) as off from kept) qualify row_number() over (partition by symbol, island, tf order by off, level, side, age_bars) = 1""",
    "groups_": f"""
  select symbol, island, avg(level) as level, any_value(price) as price, count(*) as n, count(*) filter (level < price) as below, count(distinct tf)::int as n_tf, string_agg(distinct tf, ' + ' order by tf) as timeframes,
    sum(strength)::bigint as force, sum(strength * {case('tf', TF_WEIGHT, 1.0)} * exp(-{case('tf', TF_LAMBDA, 1.5)} * least(greatest(age_bars / greatest(n_bars, 1), 0.0), 1.0))) as terms,
    sum(is_major::int) as majors, max({SEVERITY}) as severity from nearest group by symbol, island""",
    "confluences_": f"""
  select *, case type when 'Pivot' then '↔ PIVOT ZONE' when 'Support' then '🟢 BUY ZONE' else '🔴 SELL ZONE' end as signal,
    case when dist_pct < 0.5 then '🔥 ZONE CHAUDE' when dist_pct < 1.5 then '⚠️ Proche' else '' end as alert, {STATUS} as status from (
    select *, case when dist_pct <= 0.50 then 'Pivot' when below >= n - below then 'Support' else 'Resistance' end as type from (
      select *, abs(price - level) / price * 100 as dist_pct, terms * sqrt(greatest(n_tf, 1)) * (1.0 + 0.3 * least(majors, 2)) as score from groups_))""",
    "supports": "select symbol, count(*) as n_supports, median(level) as median_support from zones where side = 'Support' group by symbol",
    "anomalies": """
  select symbol, case when price is null then 'Prix indisponible' else nullif(concat_ws(' | ',
    case when price < price_min then 'PRIX < MIN' end, case when price > price_max then 'PRIX > MAX' end,
    case when not skip_ratio_check and n_supports >= 3 and median_support > 0 and price / median_support > 3.0 then 'Ecart aberrant' end,
    case when daily_close > 0 and abs(price - daily_close) / daily_close * 100 > max_live_vs_close_pct then printf('Ecart live/close (%.1f%%)', abs(price - daily_close) / daily_close * 100) end,
    case when is_fallback then 'Prix fallback' end, case when source = 'stale' then 'Prix STALE (marché fermé)' end), '') end as anomaly from bounded left join supports using (symbol)""",
    "contexts": """
  select symbol, coalesce(nullif(concat_ws('  |  ',
    case when s is not null then printf('%s: %.5f (-%.2f%%)', case when abs(price - s) / price * 100 < 0.5 then 'SUR support' else 'S proche' end, s, abs(price - s) / price * 100) end,
    case when r is not null then printf('%s: %.5f (+%.2f%%)', case when abs(price - r) / price * 100 < 0.5 then 'SUR resistance' else 'R proche' end, r, abs(price - r) / price * 100) end), ''), 'Zone intermediaire') as price_context
  from (select symbol, price, max(level) filter (side = 'Support' and abs(level - price) / price * 100 <= 5.0) as s, min(level) filter (side = 'Resistance' and level > price and abs(level - price) / price * 100 <= 5.0) as r
        from zones where tf = 'Daily' group by symbol, price)""",
    "summaries": """
  select symbol, coalesce(h, 'NEUTRE') as trend_h4, coalesce(d, 'NEUTRE') as trend_daily, coalesce(w, 'NEUTRE') as trend_weekly, coalesce(price_context, '') as price_context, price as current_price,
    case when price is not null then source end as current_price_source, price_error as scan_error
  from symbols left join (select symbol, max(trend) filter (tf = 'H4') as h, max(trend) filter (tf = 'Daily') as d, max(trend) filter (tf = 'Weekly') as w from trends group by symbol) t using (symbol)
    left join contexts using (symbol) left join bounded using (symbol)""",
}
STAGES["bounded"] = STAGES["bounded"].replace("{working}", "working")


def chain(final: str, **others: str) -> str:
    """The stages that the final select needs, in order, and it; others: bodies of some stages in place of their own."""
    stages = STAGES | others
    needed, todo = set(), [final]
    while todo:
        body = todo.pop()
        for name in stages:
            if name not in needed and _uses(body, name):
                needed.add(name)
                todo.append(stages[name])
    return "with recursive " + ",\n".join(f"{n} as {'' if n in ('clusters', 'merging', 'spacing') else 'materialized '}({stages[n]})" for n in stages if n in needed) + "\n" + final


def _uses(body: str, name: str) -> bool:
    return re.search(rf"(?:from|join)\s+{name}\b", body) is not None


ORDER_BARS = """
  select o_orderkey as arrival, 'SYM' || (o_custkey % 5) || case when o_orderkey % 2 = 0 then '_USD' else '_JPY' end as symbol, o_orderdate::timestamp as ts, o_totalprice / 1000.0 as open,
    case when o_orderkey % 7 = 0 then o_totalprice / 1000.0 * 2.5 when o_orderkey % 11 = 0 then o_totalprice / 1000.0 * 0.5 else o_totalprice / 1000.0 * 1.01 end as high,
    case when o_orderkey % 13 = 0 then -(o_totalprice / 1000.0) else o_totalprice / 1000.0 * 0.99 end as low, case when o_orderkey % 17 = 0 then null else o_totalprice / 1000.0 end as close from orders"""
VALID = "coalesce(low > 0 and high > 0 and high >= low and open between low and high and close between low and high and high / low <= 1.8, false)"
NAMES = "['eur/usd', 'GBP_USD', ' usd_jpy ', 'XAU_USD', 'US30_USD', 'NAS100_USD', 'SPX500_USD', 'DE30_EUR', 'CAD_JPY', 'AUD_NZD', 'BTC_USDT', 'CHF', '']"
ZONE_Q = f"{q('level')} as level"
CONF_Q = f"symbol, island, signal, {ZONE_Q}, type, timeframes, n_tf, force, {q('score')} as score, status, {q('dist_pct')} as dist_pct, alert"
ZONE_KEYS = "symbol, tf, zone_type"


def picked(max_dist: float, min_score: float) -> str:
    return f"(select * from (select * replace ({half_even('score', 1)} as score, {half_even('dist_pct', 3)} as dist_pct, {half_even('level', 5)} as level) from confluences_) where dist_pct <= {max_dist} and score >= {min_score} and status in ('Vierge', 'Testee', 'Role Reverse'))"


def level_sql(name: str) -> str:
    return f"select symbol, tf, mult, {ZONE_Q}, strength, zone_type, {q('abs(price - level)')} as prominence, {q('abs(price - level) / atr')} as prominence_atr from {name}"


def noise_bars(limit: int) -> str:
    return f"""
with ticks as (select event_type as symbol, ts, event_id as place, 100.0 + value / 10.0 as price from events),
h4 as (select symbol, time_bucket(interval 4 hours, ts) as start, arg_min(price, (ts, place)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, place)) as close from ticks group by symbol, start),
long_bars as (
  select symbol, 'H4' as tf, start as ts, open, high, low, close from h4
  union all select symbol, 'Daily', date_trunc('day', start), arg_min(open, start), max(high), min(low), arg_max(close, start) from h4 group by symbol, date_trunc('day', start)
  union all select symbol, 'Weekly', date_trunc('week', start), arg_min(open, start), max(high), min(low), arg_max(close, start) from h4 group by symbol, date_trunc('week', start)),
bars as (select *, count(*) over (partition by symbol, tf) as n_bars from (
  select * from long_bars where low > 0 and high >= low and open between low and high and close between low and high and high / low <= 1.8 qualify row_number() over (partition by symbol, tf order by ts desc) <= {limit}))
select symbol, tf, n_bars::int as n_bars, {q('arg_max(close, ts)')} as last_close, case when n_bars >= 2 and avg(high - low) > 0 then {q('avg(high - low)')} end as atr from bars group by symbol, tf, n_bars"""


def safe_text() -> str:
    body = f"translate(coalesce('🟢⚠️ ' || text, ''), '{ACCENTED}', '{PLAIN}')"
    for symbol, tag in SYMBOL_TAGS:
        body = f"replace({body}, '{symbol}', '{tag}')"
    return f"select doc_id, case when length(t) > 200 then substr(t, 1, 197) || '...' else t end as text from (select doc_id, regexp_replace({body}, '[^\\x{{0}}-\\x{{FF}}]', '?', 'g') as t from documents)"


def redact_text() -> str:
    body = "text"
    for pattern in REDACT_PATTERNS:
        body = f"regexp_replace({body}, {text(pattern)}, '\\1{REDACTED}', 'gi')"
    return f"select doc_id, {body} as text from documents"


SQL = {
    "bars_h4": chain(f"select {BAR_SQL.replace('ts,', 'start,', 1)} from h4"),
    "bars_daily": chain(f"select {BAR_SQL} from long_bars where tf = 'Daily'"),
    "bars_weekly": chain(f"select {BAR_SQL} from long_bars where tf = 'Weekly'"),
    "bar_validity": f"with b as ({ORDER_BARS}) select arrival, symbol, {VALID} as is_valid from b",
    "bar_dedupe_keep_last": f"""with b as ({ORDER_BARS}), last as (select * from b where close is not null qualify row_number() over (partition by symbol, ts order by arrival desc) = 1)
select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, arrival, {q('close')} as close from last where {VALID}""",
    "last_n_bars": chain(f"select symbol, tf, bar_idx, n_bars, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {q('close')} as close from bars"),
    "profile_lookup": chain(f"""select symbol, p.profile_key, asset_class, {q('cluster_radius_atr')} as cluster_radius_atr, {q('merge_threshold_atr')} as merge_threshold_atr, {q('pivot_prominence_atr')} as pivot_prominence_atr, skip_ratio_check,
  {q('price_min')} as price_min, {q('price_max')} as price_max, ignore_wick_filter, {q('major_pivot_mult')} as major_pivot_mult, {q('max_high_low_ratio')} as max_high_low_ratio, {q('max_cluster_width_pct')} as max_cluster_width_pct
from (select unnest({NAMES}) as symbol) s join profiles p on p.profile_key = {KEY}"""),
    "min_touches_by_tf": chain(f"""select symbol, tf, {MIN_TOUCHES} as min_touches
from (select symbol, unnest({list(TIMEFRAMES)}) as tf from (select unnest({NAMES}) as symbol) where symbol not in ('eur/usd', ' usd_jpy ', '')) s join profiles p on p.profile_key = {KEY}"""),
    "true_range": chain(f"select symbol, tf, bar_idx, {q('true_range')} as true_range from ranges"),
    "atr": chain(f"select symbol, tf, n_bars, {q('last_close')} as last_close, {q('atr')} as atr from atrs"),
    "atr_short_frame": noise_bars(9),
    "trend_label": chain(f"select symbol, tf, {q('slope')} as slope, trend from trends"),
    "trend_log_fit": chain(f"select symbol, tf, bar_idx, {q('slope')} as slope, {q('intercept')} as intercept, {q('fitted')} as fitted from log_fit"),
    "trend_support_levels": chain(level_sql("support_levels")),
    "trend_resistance_levels": chain(level_sql("resistance_levels")),
    "trend_zone_dedupe": chain(f"select symbol, tf, zone_type, count(*) as n, {q('min(level)')} as lowest, {q('max(level)')} as highest from trend_zones group by symbol, tf, zone_type"),
    "decay_weights": chain(f"select symbol, tf, bar_idx, {q('0.35 + 0.65 * (bar_idx / (n_bars - 1))')} as weight from bars"),
    "prominence_threshold": chain(f"select symbol, tf, {q('full_floor')} as full, {q('half_floor')} as half from limits").replace("as full,", 'as "full",'),
    "swing_highs": chain(f"select symbol, tf, bar_idx, {q('high')} as high from swings where is_high"),
    "swing_lows": chain(f"select symbol, tf, bar_idx, {q('low')} as low from swings where is_low"),
    "swing_wick_filtered": chain(f"select symbol, tf, kind, bar_idx, {q('price')} as price from candidates"),
    "pivot_prominence": chain(f'select symbol, tf, kind, bar_idx, {q("prominence")} as prominence, full_ as "full", half from candidates'),
    "pivot_fallback_tier": chain(f"select symbol, tf, tier, count(*) as n, {q('sum(prominence)')} as prominence from tiered group by symbol, tf, tier"),
    "pivot_merge": chain(f"""select symbol, tf, kind, bar_idx, {q('price')} as price, {q('prominence')} as prominence from (
  select symbol, tf, kind, bar_idx, price, prominence, 0 as origin from candidates where full_
  union all select symbol, tf, kind, bar_idx, price, prominence * case when bar_idx % 2 = 0 then 1.5 else 0.5 end, 1 from candidates where half)
qualify row_number() over (partition by symbol, tf, bar_idx, kind order by prominence desc, origin) = 1"""),
    "cluster_1d": chain(f"select symbol, tf, kind, bar_idx, {q('price')} as price, cluster_id from clusters"),
    "cluster_metrics": chain(f"select symbol, tf, kind, cluster_id, {ZONE_Q}, {q('prominence')} as prominence, {q('max_prominence')} as max_prominence, touches, last_idx, n_pivots from metrics"),
    "zone_from_cluster": chain(f"select {ZONE_KEYS}, {ZONE_Q}, strength, age_bars, {q('prominence')} as prominence, {q('prominence_atr')} as prominence_atr, is_major from raw_zones"),
    "zone_break_index": chain(f"select {ZONE_KEYS}, {ZONE_Q}, last_idx, coalesce(break_idx, -1) as break_idx, coalesce(retest_idx, -1) as retest_idx, coalesce(undone, -1) as undone from staged"),
    "zone_test_flags": chain(f"select {ZONE_KEYS}, last_idx, {ZONE_Q}, sum(tested::int)::bigint as n_tested, sum(broke::int)::bigint as n_broke, sum(near::int)::bigint as n_near, sum(undone::int)::bigint as n_undone from flags group by {ZONE_KEYS}, last_idx, flags.level"),
    "zone_status": chain(f"select {ZONE_KEYS}, {ZONE_Q}, strength, status from statused"),
    "zone_merge": chain(f"select {ZONE_KEYS}, {ZONE_Q}, strength, age_bars, status, {q('prominence')} as prominence, {q('prominence_atr')} as prominence_atr, is_major from merged"),
    "zone_reclassify": chain(f"select symbol, tf, {ZONE_Q}, zone_type, strength from typed"),
    "zone_split": chain(f"select symbol, tf, side, zone_type, {ZONE_Q}, strength, age_bars, status from zones"),
    "near_price": chain(f"select symbol, tf, {ZONE_Q}, side, near_price from zones"),
    "structural_scores": chain(f"select symbol, tf, side, {ZONE_Q}, " + q(f"strength * {case('tf', TF_WEIGHT, 1.0)} * exp(-{case('tf', TF_LAMBDA, 1.5)} * (age_bars / n_bars))") + " as score from zones"),
    "level_islands": chain(f"select symbol, island, tf, {ZONE_Q}, side from islands"),
    "confluence_filter": chain(f"select symbol, island, tf, {ZONE_Q}, is_major from kept"),
    "nearest_per_tf": chain(f"select symbol, island, tf, {ZONE_Q}, strength from nearest"),
    "confluence_score": chain(f"select symbol, island, {ZONE_Q}, n_tf, force, {q('score')} as score from confluences_"),
    "confluence_type": chain(f"select symbol, island, type, signal, status, alert, {q('dist_pct')} as dist_pct from confluences_"),
    "confluences": chain(f"select {CONF_Q} from confluences_"),
    "working_price": chain(f"select symbol, {q('raw_price')} as raw_price, is_fallback, source, {q('daily_close')} as daily_close from working"),
    "price_bounds": chain("select 1 from profiles").rsplit("\n", 1)[0] + f""", w as (select ['EUR_USD', 'USD_JPY', 'XAU_USD', 'GBP_USD', 'NAS100_USD'][id % 5 + 1] as symbol, pow(2.0, (id - 10)::double / 2.0) * 1.013 as raw_price from range(40) r(id)),
  b as ({STAGES['bounded'].replace('from working w', 'from w')})
select symbol, {q('raw_price')} as raw_price, {q('price')} as price, price_error from b""",
    "data_anomaly": chain("select symbol, anomaly from anomalies"),
    "support_ratio": chain(f"select symbol, n_supports, {q('median_support')} as median_support from supports"),
    "coverage_gaps": chain("""select symbol, 'missing' as gap from symbols where symbol not in (select symbol from bars union all select 'ZZZ_USD')
union all select distinct symbol, 'extra' from (select symbol from bars union all select 'ZZZ_USD') x where symbol not in (select symbol from symbols)"""),
    "price_context": chain("select symbol, price_context from contexts"),
    "display_rows": chain(f"""select replace(symbol, '_', '/') as symbol, tf, printf('%.5f', price) as price_text, type, level_text, printf('%d touches', strength::int) as force,
  {q(f"strength * {case('tf', TF_WEIGHT, 1.0)} * exp(-{case('tf', TF_LAMBDA, 1.5)} * (age_bars / n_bars))")} as score, status, printf('%.2f%%', dist) as dist, printf('%.1fx', abs(price - level) / atr) as dist_atr, dist <= pdf_max_dist_pct as in_pdf
from (select *, abs(price - level) / price * 100 as dist, case when near_price then 'PIVOT' else side end as type, printf('%.5f', level) as level_text from zones)
qualify row_number() over (partition by symbol, tf, level_text, type order by side <> 'Support', level, age_bars) = 1"""),
    "filter_confluences": chain(f"select symbol, island, {q('score')} as score, {q('dist_pct')} as dist_pct, status from {picked(2.0, 20.0)}".replace("from (select * from confluences_", "from (select * from confluences_")),
    "json_export": chain(f"""select symbol, {q('current_price')} as current_price, current_price_source, case when zones is null then 'none_detected' else 'found' end as zones_scan_status, coalesce(zones, '') as zones
from summaries left join (select symbol, string_agg(printf('%.5f|%s|%s|%d', level, type, status, force::int), ';' order by level) as zones from {picked(2.0, 20.0)} group by symbol) z using (symbol)"""),
    "llm_brief": chain(f"""select symbol, '### ' || symbol || chr(10) || string_agg(printf('- %s `%.5f` | Sc:%.1f | %s | %.3f | %s', signal, level, score, status, dist_pct, timeframes), chr(10) order by level) as brief
from {picked(5.0, 10.0)} group by symbol"""),
    "safe_text": safe_text(),
    "redact_text": redact_text(),
    "scan_summary": chain(f"select symbol, trend_h4, trend_daily, trend_weekly, price_context, {q('current_price')} as current_price, current_price_source, scan_error from summaries"),
    "class_a_totals": chain(f"""select symbol, tf, grouping(symbol, tf)::bigint as level, count(*) filter (kind = 'pivots') as n_pivots, count(*) filter (kind = 'trend_zones') as n_trend_zones, count(*) filter (kind = 'zones') as n_zones,
  count(*) filter (kind = 'after_confluence') as n_after_confluence, count(*) filter (kind = 'exported_json') as n_exported_json, count(*) filter (kind = 'exported_llm') as n_exported_llm
from (select symbol, tf, 'pivots' as kind from pivots_ union all select symbol, tf, 'trend_zones' from trend_zones where asset_class in ('INDEX', 'METAL') union all select symbol, tf, 'zones' from zones
  union all select symbol, null, 'after_confluence' from confluences_ union all select symbol, null, 'exported_json' from {picked(2.0, 20.0)} union all select symbol, null, 'exported_llm' from {picked(2.0, 57.0)}) x
group by grouping sets ((symbol, tf), (symbol), ()) having not (grouping(symbol, tf) = 0 and tf is null)"""),
    "requested_frames": chain(f"""select symbol, tf, count(b.bar_idx) as n_bars
from (select symbol, unnest({list(TIMEFRAMES)}) as tf from symbols) s left join bars b using (symbol, tf) group by symbol, tf"""),
    "candle_payloads": noise_bars(500).rsplit("\nselect", 1)[0].replace("arg_max(price, (ts, place)) as close from", "arg_max(price, (ts, place)) as close, count(*) as volume from").replace(
        "arg_max(close, start) from", "arg_max(close, start), sum(volume) from").replace("high, low, close from h4", "high, low, close, volume from h4") + f"""
select symbol, tf, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {q('close')} as close, volume::bigint as volume from (
  select *, row_number() over (partition by symbol, tf order by ts) - 1 as bar_idx from bars) where bar_idx % 5 <> 0
qualify row_number() over (partition by symbol, tf order by bar_idx desc) <= 500""",
    "quote_payloads": """select n_name as symbol, case when n_nationkey > 0 and n_nationkey % 7 <> 0 then (n_nationkey + n_nationkey + 1) / 2.0 end as price,
  case when n_nationkey > 0 and n_nationkey % 7 <> 0 then case when n_nationkey % 3 = 0 or n_nationkey % 2 = 0 then 'live' else 'stale' end end as source from nation""",
    "cache_freshness": """select id, (id * 37) % 700 <= case when id % 5 = 0 then 20 else [60, 300, 600, 300][id % 4 + 1] end as fresh from range(400) r(id)""",
    "coverage_patched": chain("""select symbol, null::varchar as scan_error from (select distinct symbol from trends)
union all select symbol, 'Symbole manquant dans les resultats' from symbols where symbol not in (select symbol from trends)"""),
    "confluence_thresholds": chain(f"select symbol, {case('symbol', CONFLUENCE_THRESHOLDS, UI_CONFLUENCE_THRESHOLD)} as threshold from symbols"),
    "report_lines": "",
    "scan_sanitized": f"""with b as ({ORDER_BARS}), latest as (select * from b where {VALID} qualify row_number() over (partition by symbol order by arrival desc) <= 500),
kept as (select * from latest qualify row_number() over (partition by symbol, ts order by arrival desc) = 1)
select symbol, 'Daily' as tf, (row_number() over (partition by symbol order by ts) - 1)::int as bar_idx, (count(*) over (partition by symbol))::int as n_bars, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, {q('close')} as close from kept""",
    "confluences_user_threshold": chain(f"select {CONF_Q} from confluences_").replace(case("symbol", CONFLUENCE_THRESHOLDS, UI_CONFLUENCE_THRESHOLD), case("symbol", CONFLUENCE_THRESHOLDS, 0.3)),
    "confluences_profile_threshold": chain(f"select {CONF_Q} from confluences_").replace(case("symbol", CONFLUENCE_THRESHOLDS, UI_CONFLUENCE_THRESHOLD), "1.0"),
    "filter_rounded": chain(f"select symbol, island, {half_even('score', 1)} as score, {half_even('dist_pct', 3)} as dist_pct, {half_even('level', 5)} as level from confluences_"),
    "json_document": chain(f"""select symbol, (row_number() over (order by symbol) - 1)::int as place, {half_even('current_price', 5)} as current_price, current_price_source, case when n is null then 'none_detected' else 'found' end as zones_scan_status, coalesce(n, 0)::int as n_zones, force,
  (select coalesce(string_agg(symbol, ',' order by symbol), '') from summaries where symbol not in (select symbol from {picked(5.0, 20.0)})) as assets_with_no_zones
from summaries left join (select symbol, count(*) as n, sum(force)::bigint as force from {picked(5.0, 20.0)} group by symbol) z using (symbol)"""),
    "brief_document": chain(f"""select 1 as part, '# BRIEF S/R' || chr(10) || '_Genere le 01/02/2024 00:00_' || chr(10) || chr(10) || coalesce((select string_agg(body, chr(10) order by place) from (
  select list_position({{names}}, symbol) as place, '### ' || symbol || chr(10) || string_agg(printf('- %s `%.5f` | Sc:%.1f | %s | %.3f | %s', signal, level, score, status, dist_pct, timeframes), chr(10) order by island) || chr(10) as body
  from {picked(5.0, 10.0)} group by symbol)), '') as brief""").replace("{names}", "['EUR_USD', 'USD_JPY', 'XAU_USD', 'GBP_USD', 'NAS100_USD']"),
    "report_confluences": chain(f"""select (row_number() over (order by score desc, symbol, level))::int as place, symbol, {q('level')} as level, {q('score')} as score, {q('dist_pct')} as dist_pct
from (select * replace ({half_even('score', 1)} as score, {half_even('dist_pct', 3)} as dist_pct, {half_even('level', 5)} as level) from confluences_) where dist_pct <= 3.0"""),
}
CELLS = " || ' ' || ".join(f"rpad(case when length({c}) > 14 then substr({c}, 1, 13) || '.' else {c} end, 14, ' ')" for c in ("symbol", "price_text", "type", "level_text", "force", "status", "dist", "dist_atr"))
SQL["report_lines"] = SQL["display_rows"].rsplit("\nselect replace", 1)[0] + f""",
shown as (select replace{SQL['display_rows'].rsplit(chr(10) + 'select replace', 1)[1]})
select 0 as section, printf('[!] %s : %s', symbol, anomaly) as line from ({chain('select symbol, anomaly from anomalies')}) where anomaly is not null and anomaly <> 'Prix STALE (marché fermé)'
union all select case tf when 'H4' then 1 when 'Daily' then 2 else 3 end, {CELLS} from shown where in_pdf"""


def _results(more: str) -> str:
    """The row of each symbol with its lists; one with an error has nothing else."""
    per_tf = "select symbol, string_agg(tf || '=' || trend, ',' order by tf) as trends, string_agg(tf || '=' || n_bars, ',' order by tf) as bars_map, list(tf) as tfs from (select symbol, tf, any_value(trend) as trend, any_value(n_bars) as n_bars from trends join atrs using (symbol, tf) group by symbol, tf) group by symbol"
    missing = f"array_to_string(list_filter({list(TIMEFRAMES)}, lambda x: not list_contains(coalesce(tfs, []), x)), ',')"
    own = lambda c, name: f"case when scan_error is null then {c} end as {name}"
    return f"""select symbol, scan_error, {q('current_price')} as current_price, {own(missing, 'missing_tfs')}, {own('bars_map', 'bars_map')}, {more.format(own=own)}
from summaries left join ({per_tf}) t using (symbol) left join anomalies using (symbol)"""


SQL["scan_results"] = chain(_results("current_price_source, case when scan_error is null then price_context end as price_context, case when scan_error is null then anomaly end as anomaly, case when scan_error is null then trends end as trends"))
#: A frame whose body can't be read has no bars; one symbol has no quote.
SQL["scan_errors"] = (
    chain(_results("(select string_agg(tf || '=' || error, ',' order by tf) from (values ('USD_JPY', 'H4', 'not JSON'), ('USD_JPY', 'Daily', 'unreadable candle'), ('USD_JPY', 'Weekly', 'no answer'), ('XAU_USD', 'Weekly', 'unreadable candle')) e(symbol, tf, error) where e.symbol = summaries.symbol) as frame_errors, n_zones, levels")
    + f" left join (select symbol, count(*) as n_zones, {q('sum(level)')} as levels from zones group by symbol) z using (symbol)")
    .replace("from long_bars where low > 0", "from long_bars where symbol <> 'USD_JPY' and not (symbol = 'XAU_USD' and tf = 'Weekly') and low > 0")
    .replace("tf = 'Daily' and symbol in ('EUR_USD', 'USD_JPY')", "tf = 'Daily' and symbol = 'EUR_USD'")
)

_TTL = case("tf", TTL, TTL_OTHER)
SQL["stale_frames"] = f"""with log as (select 'U' || (user_id % 40) as symbol, ({list(TIMEFRAMES)})[event_id % 3 + 1] as tf, event_id as fetched_at, case when value < 8 then 0 else 100 end as rows from events),
latest as (select symbol, tf, max(fetched_at) as fetched_at, arg_max(rows, fetched_at) as rows from log group by symbol, tf),
requested as (select symbol, unnest({list(TIMEFRAMES)}) as tf from (select distinct symbol from log union all select 'ZZZ_USD'))
select symbol, tf, case when fetched_at is null then 'never' when rows = 0 then 'empty' else 'old' end as reason from requested left join latest using (symbol, tf)
where not coalesce((select max(fetched_at) + 3 from log) - fetched_at <= case when rows = 0 then {TTL_EMPTY} else {_TTL} end, false)"""
SQL["candles_upserted"] = f"select symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, arrival, {q('close')} as close from ({ORDER_BARS}) qualify row_number() over (partition by symbol, ts order by arrival desc) = 1"

#: Bars of events: three time frames of five names without a profile of their own, weekly frames of under 15 bars among them.
NOISE = {
    "ticks": "select event_type as symbol, ts, event_id as place, 100.0 + value / 10.0 as price from events",
    "h4": "select symbol, 'H4' as tf, time_bucket(interval 4 hours, ts) as start, arg_min(price, (ts, place)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, place)) as close, count(*) as volume from ticks group by symbol, start",
    "usable": "select a.*, p.* from atrs a join profiles p on p.profile_key = 'DEFAULT' where atr > 0",
}
_PIVOTS = f"select symbol, tf, kind, bar_idx, {q('price')} as price, {q('weight')} as weight, {q('prominence')} as prominence from "
SQL["pivot_peaks"] = chain(_PIVOTS + "extra", **NOISE, poor="select symbol, tf, atr, half_floor as least_ from limits")
SQL["pivots_with_fallback"] = chain(_PIVOTS + "pivots_", **NOISE)
SQL["pivots_of_short_frames"] = chain(_PIVOTS + "pivots_", **NOISE).replace("order by ts desc) <= 500", "order by ts desc) <= 12")
SQL["rescan_changed_frames"] = chain(f"""select symbol, tf, symbol = 'XAU_USD' and tf = 'H4' as recomputed, coalesce(n, 0)::bigint as n_zones, levels
from usable left join (select symbol, tf, count(*) as n, {q('sum(level)')} as levels from zones group by symbol, tf) z using (symbol, tf)""")


def _latin(x: str) -> str:
    body = f"translate(coalesce({x}, ''), '{ACCENTED}', '{PLAIN}')"
    for symbol, tag in SYMBOL_TAGS:
        body = f"replace({body}, '{symbol}', '{tag}')"
    return f"regexp_replace({body}, '[^\\x{{0}}-\\x{{FF}}]', '?', 'g')"


def _page_row(values: dict, widths: dict) -> str:
    def cell(x: str, width: int) -> str:
        n = int(width / 1.25)
        text_ = f"(case when length({x}) > {n} then substr({x}, 1, {n - 1}) || '.' else {x} end)"
        return f"rpad(repeat(' ', ((({n} - length({text_})) // 2))::int) || {text_}, {n}, ' ')"

    return "'|' || " + " || '|' || ".join(cell(_latin(f"({values[c]})::varchar"), w) for c, w in widths.items()) + " || '|'"


def _report_pages(per_page: int) -> str:
    zone_heads = {c: text(h) for c, h in HEADS.items()}
    found_heads = zone_heads | {"score_text": "'Score'", "force": "'Force Totale'"}
    own = {c: c for c in HEADS}
    numbered = lambda source, section, order, widths: f"select {section} as section, row_number() over (order by {order}) - 1 as place, {_page_row(own, widths)} as text from {source}"
    shown = SQL["display_rows"].rsplit("\nselect replace", 1)[0] + ",\nshown as (select *, printf('%.1f', score) as score_text from (select replace" + SQL["display_rows"].rsplit("\nselect replace", 1)[1] + ")),\n"
    others = chain("select 1 from confluences_ join anomalies using (symbol)").removeprefix("with recursive ").rsplit("\nselect 1", 1)[0]
    known = set(re.findall(r"(?m)^(?:with recursive )?(\w+) as (?:materialized )?\(", shown))
    more = ",\n".join(f"{n} as materialized ({STAGES[n]})" for n in re.findall(r"(?m)^(\w+) as (?:materialized )?\(", others) if n not in known)
    return f"""{shown}{more},
found as (select replace(symbol, '_', '/') as symbol, signal, printf('%.5f', level) as level_text, type, timeframes, n_tf, force, printf('%.1f', score) as score_text, status, printf('%.3f', dist_pct) as dist_text, alert, score, level
  from (select * replace ({half_even('score', 1)} as score, {half_even('dist_pct', 3)} as dist_pct, {half_even('level', 5)} as level) from confluences_)),
odd as (select row_number() over (order by text) as place, text from (select {_latin("printf('[!] %s : %s', replace(symbol, '_', '/'), anomaly)")} as text from anomalies where anomaly is not null and anomaly <> 'Prix STALE (marché fermé)')),
data as (
  {numbered('found', 1, 'score desc, symbol, level', CONFLUENCE_WIDTHS)}
  union all {" union all ".join(numbered(f"(select * from shown where in_pdf and tf = '{tf}')", k, 'symbol, type, level_text', ZONE_WIDTHS) for k, tf in enumerate(TIMEFRAMES, 2))}),
placed as (
  select section, (place // {per_page})::int as part, (place % {per_page} + 2)::int as line, text from data
  union all select distinct section, (place // {per_page})::int, 0, case section when 1 then 'ZONES DE CONFLUENCE' {" ".join(f"when {k} then 'Analyse {tf}'" for k, tf in enumerate(TIMEFRAMES, 2))} end from data
  union all select distinct section, (place // {per_page})::int, 1, case section when 1 then {_page_row(found_heads, CONFLUENCE_WIDTHS)} else {_page_row(zone_heads, ZONE_WIDTHS)} end from data
  union all select 0, ((place - 1) // {per_page})::int, ((place - 1) % {per_page} + 1)::int, text from odd
  union all select 0, 0, 0, 'ALERTES ANOMALIES' where exists (select 1 from odd)),
sizes as (select section, coalesce(sum(n) over (order by section rows between unbounded preceding and 1 preceding), 0) as before_ from (select section, max(part) + 1 as n from placed group by section))
select (before_ + part + 1)::int as page, line, text from placed join sizes using (section)"""


SQL["report_pages"] = _report_pages(12)
