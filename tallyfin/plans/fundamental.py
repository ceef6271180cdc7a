"""Queries on fundamentals, valuation and paged text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfin.functions import series
from tallyfin.operators import asof, models, montecarlo, risk, screen, textclean, valuation
from tallyfin.plans.market import BARS, RETS, rounded, uniform_sql
from tallyfin.session import shared_folder
from tallyfin.sources import paged, sinks, tables

#: Production parameters: pages that make a line repeated, draws.
HEADS = ("Item 1A. ", "\tITEM 7 - ", "item\u00a03", "Items 4 ", "See Item 5. ", "")
MIN_PAGES, DRAWS = 3, 10_000


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.fundamentals(spark, sf_dir)
    return screen.rules(screen.changes(screen.intrinsic_value(f)))


def q_fundamentals(spark, sf_dir):
    return rounded(tables.fundamentals(spark, sf_dir), 4)


def q_deltas(spark, sf_dir):
    made = screen.changes(tables.fundamentals(spark, sf_dir))
    names = [f"{n}_delta{k}" for n in screen.METRICS for k in ("", "_shift1", "_shift2")]
    return rounded(made.select("ticker", "calendardate", *names), 6)


def q_rules(spark, sf_dir):
    return _screened(spark, sf_dir).select("ticker", "calendardate", "roic_incr", "fcfps_incr", "ebitda_incr", "grossmarg_incr", "sharesout_decr")


def q_growth_rate(spark, sf_dir):
    return rounded(screen.intrinsic_value(tables.fundamentals(spark, sf_dir)).select("ticker", "calendardate", "growth_rate"), 5)


def q_intrinsic_value(spark, sf_dir):
    return rounded(screen.intrinsic_value(tables.fundamentals(spark, sf_dir)).select("ticker", "calendardate", "intrinsic_value"), 3)


def q_criteria_long(spark, sf_dir):
    return rounded(screen.criteria(_screened(spark, sf_dir)), 3)


def q_final_tickers(spark, sf_dir):
    return screen.final_tickers(screen.criteria(_screened(spark, sf_dir)))


def q_latest_picks(spark, sf_dir):
    full = _screened(spark, sf_dir)
    return rounded(screen.criteria(screen.latest(full)), 3)


def _starts(spark, sf_dir):
    return screen.final_tickers(screen.criteria(_screened(spark, sf_dir))).select("ticker", F.col("calendardate").alias("start"))


def q_horizon_avgs(spark, sf_dir):
    return rounded(screen.horizon_averages(tables.daily_prices(spark, sf_dir), _starts(spark, sf_dir)), 6)


def q_price_rolling_means(spark, sf_dir):
    return rounded(screen.rolling_averages(tables.daily_prices(spark, sf_dir)), 6)


def q_point_in_time(spark, sf_dir):
    return rounded(screen.point_in_time(screen.rolling_averages(tables.daily_prices(spark, sf_dir)), F.to_date(F.lit("2000-06-30")), exact=False), 6)


def q_point_in_time_exact(spark, sf_dir):
    return rounded(screen.point_in_time(screen.rolling_averages(tables.daily_prices(spark, sf_dir)), F.to_date(F.lit("2000-06-30"))), 6)


def q_screen_join(spark, sf_dir):
    prices = tables.daily_prices(spark, sf_dir)
    picks = screen.criteria(_screened(spark, sf_dir)).filter("calendardate = date'1999-10-01'")
    final = screen.final_tickers(picks)
    forward = screen.horizon_averages(prices, final.select("ticker", F.col("calendardate").alias("start")))
    at = screen.point_in_time(screen.rolling_averages(prices), F.to_date(F.lit("2000-06-30")), exact=False)
    return rounded(screen.screen_result(final, at, tables.tickers(spark, sf_dir), picks, forward), 6)


def q_sector_filter(spark, sf_dir):
    """Fundamentals of the tickers of one sector only (an IN-list as a semi-join)."""
    wanted = tables.tickers(spark, sf_dir).filter("sector = 'ASIA'").select("ticker")
    return rounded(tables.fundamentals(spark, sf_dir).join(wanted, "ticker", "left_semi").select("ticker", "calendardate", "roic"), 6)


def q_sectors(spark, sf_dir):
    return tables.tickers(spark, sf_dir).select("sector").distinct()


def q_prev_bday(spark, sf_dir):
    days = tables.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", series.previous_business_day(F.col("day")).alias("previous"), F.date_format(F.date_sub("day", 720), "yyyy-MM-dd").alias("since"))


def _companies(spark, sf_dir):
    """A company for each nation, from its latest quarter's figures."""
    f = tables.fundamentals(spark, sf_dir)
    last = f.groupBy("ticker").agg(*(F.max_by(c, "calendardate").alias(c) for c in ("ebitdausd", "shareswadil", "epsusd", "fcfps", "grossmargin", "roic")))
    return last.select(
        F.col("ticker").alias("company"), F.round(F.col("fcfps") * F.col("shareswadil"), 2).alias("fcf"), F.lit(0.10).alias("wacc"), F.lit(0.03).alias("terminal_growth"),
        F.round(F.col("ebitdausd") * 0.5, 2).alias("debt"), F.round(F.col("ebitdausd") * 0.1, 2).alias("cash"), F.col("shareswadil").alias("shares"),
    )


def q_dcf_mc(spark, sf_dir):
    draws = montecarlo.dcf_draws(_companies(spark, sf_dir), DRAWS)
    out = montecarlo.summary(draws, "price", "company").join(draws.groupBy("company").agg(F.sum(F.col("invalid").cast("long")).alias("n_invalid")), "company")
    return rounded(out, 2)


def q_dcf_value(spark, sf_dir):
    made = montecarlo.valued(_companies(spark, sf_dir).withColumn("fcf_growth", F.lit(0.06)))
    return rounded(made.select("company", "pv_fcf", "pv_terminal", "enterprise_value", "price"), 2)


def q_pv_split(spark, sf_dir):
    """How much of each company's value its cash flows and its terminal value make up."""
    made = montecarlo.valued(_companies(spark, sf_dir).withColumn("fcf_growth", F.lit(0.06)))
    parts = F.array(*(F.struct(F.lit(n).alias("part"), F.col(c).alias("value"), F.try_divide(F.col(c), F.col("enterprise_value")).alias("share")) for n, c in (("cash flows", "pv_fcf"), ("terminal value", "pv_terminal"))))
    made = made.select("company", F.explode(parts).alias("p")).select("company", "p.*")
    return made.select("company", "part", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"))


def q_dcf_sensitivity(spark, sf_dir):
    grid = valuation.sensitivity(_companies(spark, sf_dir).drop("wacc", "terminal_growth").withColumn("fcf_growth", F.lit(0.06)))
    return rounded(montecarlo.valued(grid).select("company", "wacc", "terminal_growth", "price"), 2)


def q_dcf_projection(spark, sf_dir):
    made = valuation.projected(_companies(spark, sf_dir).withColumn("growth", F.lit(0.06)))
    return rounded(made.select("company", "year", "projected", valuation.discounted(F.col("projected"), F.col("wacc"), F.col("year")).alias("present")), 2)


def q_wacc(spark, sf_dir):
    c = _companies(spark, sf_dir).withColumn("equity", F.col("shares") * 100)
    cost = valuation.weighted_cost_of_capital(F.col("equity"), F.col("debt"), F.lit(0.12), F.lit(0.05), F.lit(0.25))
    return rounded(c.select("company", cost.alias("cost")), 6)


def q_historical_metrics(spark, sf_dir):
    f = tables.fundamentals(spark, sf_dir).select("ticker", "calendardate", F.col("ebitdausd").alias("value"))
    return rounded(valuation.historical_metrics(f), 4)


def q_ratios(spark, sf_dir):
    f = tables.fundamentals(spark, sf_dir)
    base = f.select(
        "ticker", "calendardate", (F.col("epsusd") * 15).alias("price"), F.col("epsusd").alias("eps"), (F.col("ebitdausd") / F.col("shareswadil")).alias("book_per_share"), F.col("fcfps").alias("sales_per_share"),
        (F.col("ebitdausd") * 8).alias("enterprise_value"), F.col("ebitdausd").alias("ebitda"), (F.col("roic") * 10).alias("growth_percent"),
    )
    return rounded(valuation.multiples(base).select("ticker", "calendardate", "pe", "pb", "ps", "ev_ebitda", "peg"), 5)


def q_dividend_value(spark, sf_dir):
    f = tables.fundamentals(spark, sf_dir)
    return rounded(f.select(
        "ticker", "calendardate", valuation.dividend_value(F.col("epsusd") * 0.4, F.col("roic") / 20, F.lit(0.08)).alias("ddm"), valuation.asset_value(F.col("ebitdausd"), F.col("ebitdausd") * 0.5, F.col("shareswadil")).alias("nav"),
        valuation.free_cash_flow_to_equity(F.col("ebitdausd"), F.col("ebitdausd") * 0.1, F.col("ebitdausd") * 0.2, F.col("ebitdausd") * 0.05, F.col("ebitdausd") * 0.03).alias("fcfe"),
    ), 3)


def q_comparables(spark, sf_dir):
    f = tables.fundamentals(spark, sf_dir).join(tables.tickers(spark, sf_dir), "ticker").select("ticker", "sector", "calendardate", "epsusd", (F.col("ebitdausd") / F.col("shareswadil") / F.col("epsusd")).alias("multiple"))
    return rounded(valuation.comparables(f, "multiple", "epsusd", "sector").select("ticker", "sector", "calendardate", "median_multiple", "implied_value"), 3)


def q_page_lines(spark, sf_dir):
    return textclean.page_lines(tables.filing_pages(spark, sf_dir))


def q_repeated_lines(spark, sf_dir):
    return textclean.repeated_lines(tables.filing_pages(spark, sf_dir), min_page_count=MIN_PAGES)


def q_strip_lines(spark, sf_dir):
    pages = tables.filing_pages(spark, sf_dir)
    return textclean.strip_repeated(pages, textclean.repeated_lines(pages, min_page_count=MIN_PAGES))


def q_headings(spark, sf_dir):
    lines = textclean.page_lines(tables.filing_pages(spark, sf_dir))
    before = F.element_at(F.array(*map(F.lit, HEADS)), F.pmod(F.col("pos"), F.lit(len(HEADS))).cast("int") + 1)
    return lines.select("doc", "page", "pos", textclean.mark_heading(F.concat(before, "line")).alias("marked"))


def q_repeated_rule(spark, sf_dir):
    """By the rule itself (0.6 of the pages, three at least): an hour's events as pages of two lines."""
    return textclean.repeated_lines(_notices(spark, sf_dir))


def _notices(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    return e.select(hour.alias("doc"), F.col("event_id").alias("page"), F.concat(F.lit("\t"), "event_type", F.lit("\u00a0\nuser "), F.pmod("user_id", F.lit(3)).cast("string")).alias("text"))


def q_markdown(spark, sf_dir):
    pages = tables.filing_pages(spark, sf_dir)
    made = textclean.assemble(pages, textclean.strip_repeated(pages, textclean.repeated_lines(pages, min_page_count=MIN_PAGES)), _page_tables(spark, sf_dir))
    return made.select("doc", F.md5("markdown").alias("digest"), F.length("markdown").cast("long").alias("chars"))


def _page_tables(spark, sf_dir):
    """Two tables on every tenth page: one of its size, one of a single row, which is not shown."""
    pages = tables.filing_pages(spark, sf_dir).filter("page % 10 = 0")
    sizes = F.array(F.array(F.lit("page"), F.lit(" chars\n")), F.array(F.col("page").cast("string"), F.length("text").cast("string")))
    both = F.array(F.struct(F.lit(0).alias("pos"), sizes.alias("rows")), F.struct(F.lit(1).alias("pos"), F.slice(sizes, 1, 1).alias("rows")))
    return pages.select("doc", "page", F.explode(both).alias("t")).select("doc", "page", "t.pos", "t.rows")


def q_cid_pages(spark, sf_dir):
    """Every seventh page has glyphs that the font cannot map, and every fifth what looks like them."""
    pages = tables.filing_pages(spark, sf_dir)
    glyphs = F.when(F.col("page") % 7 == 0, F.concat(F.lit("(cid:"), F.col("page").cast("string"), F.lit(")"))).when(F.col("page") % 5 == 0, F.lit("(cid: 5) cid:6")).otherwise("")
    return textclean.broken_glyph_pages(pages.withColumn("text", F.concat("text", glyphs)))


def q_table_scan(spark, sf_dir):
    """A table's columns and rows as the caller asks for them, as known on a day: pages cut from orders, read through the paged source with its filters pushed."""
    endpoint = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    paged.write_pages(tables.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate")), endpoint)
    asked = paged.scan_pages(spark, endpoint, ["o_orderkey", "o_orderstatus", "o_totalprice"], {"o_orderstatus": ["F", "P"]}, as_of=("o_orderdate", "1997-06-30"))
    return rounded(asked, 2)


def q_file_scan(spark, sf_dir):
    """The same of the table's own files."""
    asked = tables.scan(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], {"o_orderstatus": ["F", "P"]}, as_of=("o_orderdate", "1997-06-30"))
    return rounded(asked, 2)


def q_asof_prices(spark, sf_dir):
    """Every quarter's figures with the price last known at its end, at most a week old."""
    quarters = tables.fundamentals(spark, sf_dir).select("ticker", "calendardate", "roic")
    joined = asof.asof_join(quarters, tables.daily_prices(spark, sf_dir), "ticker", "calendardate", "date", ["close"], tolerance=F.expr("interval 7 days"), matched="price_date")
    return rounded(joined, 6)


def q_asof_bars(spark, sf_dir):
    """Every event with the close of the last hour before its own."""
    events = tables.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_type").alias("ticker"), "value")
    bars = tables.bars_hourly(spark, sf_dir).select("ticker", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), "close")
    return rounded(asof.asof_join(events, bars, "ticker", "at", "ts", ["close"], exact=False, matched="bar_end"), 6)


def q_revenue_order(spark, sf_dir):
    """Tickers of the last quarter by falling revenue, the first ten."""
    last = screen.latest(tables.fundamentals(spark, sf_dir)).select("ticker", "ebitdausd").orderBy(F.desc("ebitdausd"), "ticker").limit(10)
    return rounded(last.select("ticker", "ebitdausd", F.row_number().over(Window.orderBy(F.desc("ebitdausd"), "ticker")).alias("place")), 2)


def q_low_text_pages(spark, sf_dir):
    made = textclean.quality_report(tables.filing_pages(spark, sf_dir))
    return made.select("doc", F.explode("low_text_pages").alias("page"))


def q_md_table(spark, sf_dir):
    """Each conversation as a table of role and text."""
    turns = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    cells = F.concat(F.array(F.array(F.lit("role"), F.lit("text"))), F.transform("t", lambda x: F.array(x["role"], x["text"])))
    return rows.select("conv_id", textclean.table_markdown(cells).alias("markdown"))


def q_quality_report(spark, sf_dir):
    made = textclean.quality_report(tables.filing_pages(spark, sf_dir))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rounded(made.select("doc", "pages", "avg_chars", "n_tables", text("low_text_pages"), text("cid_pages"), "warnings"), 4)


def q_skip_done(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    return sinks.not_yet_done(docs, docs.filter("source = 'src0'"))


def q_tail_rows(spark, sf_dir):
    return rounded(models.tail(risk.returns(tables.bars_hourly(spark, sf_dir)), 7), 8)


LINES = r"lines as (select source as doc, doc_id as page, (unnest(range(len(ls))))::int as pos, unnest(ls) as line from (select source, doc_id, case when ls[-1] = '' then ls[:-2] else ls end as ls from (select source, doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') as ls from documents)))"
def _strip(x: str) -> str:
    return f"trim({x}, '{textclean.WHITE}')"


REPEATED = (
    f"{LINES}, rep as (select doc, {_strip('line')} as line, count(distinct page) as pages from lines where {_strip('line')} <> '' group by 1, 2 having count(distinct "
    f"page) >= {MIN_PAGES}), of_pages as (select source as doc, count(*) as n from documents group by 1), repeated as (select rep.* from rep join of_pages using "
    "(doc) where n >= 3)"
)
STRIPPED = f"{REPEATED}, stripped as (select l.* from lines l where not exists (select 1 from repeated r where r.doc = l.doc and r.line = {_strip('l.line')}))"


def _head(x: str) -> str:
    return f"case when regexp_matches({_strip(x)}, '{textclean.HEADING}') then '## ' || {_strip(x)} else {x} end"


FUND = (
    "f as (select n_name as ticker, date_trunc('quarter', o_orderdate)::date as calendardate, sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) as roic, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) as fcfps, "
    "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as ebitdausd, 1 - avg(l_discount) as grossmargin, sum(l_quantity) as shareswadil, avg(l_extendedprice * (1 - l_discount) / l_quantity) as epsusd "
    "from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"
)
DELTAS = (
    f"{FUND}, d0 as (select *, " + ", ".join(f"{c} / nullif(lag({c}) over w, 0) - 1 as {n}_delta" for n, c in screen.METRICS.items()) + ", epsusd / nullif(lag(epsusd) over w, 0) - 1 as eps_change from f window w as (partition by ticker order by calendardate)), "
    "d as (select *, " + ", ".join(f"lag({n}_delta, {k}) over w as {n}_delta_shift{k}" for n in screen.METRICS for k in (1, 2))
    + ", case when count(eps_change) over g >= 5 then avg(eps_change) over g end * 10 as growth_rate from d0 window w as (partition by ticker order by calendardate), g as (partition by ticker order by calendardate rows between 4 preceding and current row)), "
    "ruled as (select *, epsusd * (8.5 + 2 * growth_rate * 3) / 5 as intrinsic_value, " + ", ".join(f"coalesce({n}_delta > {n}_delta_shift1 and {n}_delta_shift1 > {n}_delta_shift2, false) as {n}_incr" for n in screen.METRICS if n != "sharesout")
    + ", coalesce(sharesout_delta <= sharesout_delta_shift1 and sharesout_delta_shift1 <= sharesout_delta_shift2, false) as sharesout_decr from d)"
)
CRITERIA = (
    f"{DELTAS}, picks as (select ticker, calendardate, 1 as criterion, intrinsic_value from ruled where roic_incr union all select ticker, calendardate, 2, intrinsic_value from ruled where fcfps_incr union all "
    "select ticker, calendardate, 3, intrinsic_value from ruled where ebitda_incr union all select ticker, calendardate, 4, intrinsic_value from ruled where fcfps_incr and grossmarg_incr union all "
    "select ticker, calendardate, 5, intrinsic_value from ruled where fcfps_incr and sharesout_decr)"
)
FINAL = (
    f"{CRITERIA}, final as (select calendardate, ticker from picks where criterion = 1 union (select calendardate, ticker from picks where criterion = 2 except "
    "select calendardate, ticker from picks where criterion in (1, 3)))"
)
DAILY = (
    "daily as (select n_name as ticker, o_orderdate::date as date, avg(o_totalprice) as close from orders join customer on o_custkey = c_custkey join nation "
    "on c_nationkey = n_nationkey group by 1, 2)"
)
MEANS = "means as (select ticker, date, close, " + ", ".join(f"case when count(close) over w{n} >= {n} then avg(close) over w{n} end as avg_{n}" for n in (15, 30, 45)) + " from daily window " + ", ".join(f"w{n} as (partition by ticker order by date rows between {n - 1} preceding and current row)" for n in (15, 30, 45)) + ")"


def _forward(source: str) -> str:
    parts = ", ".join(f"avg(case when date between (start + interval {n} month)::date - 30 and (start + interval {n} month)::date then close end) as fwd_{n}" for n in screen.HORIZONS)
    return f"select s.ticker as ticker, start, {parts} from (select ticker, calendardate as start from {source}) s left join daily on s.ticker = daily.ticker group by 1, 2"


COMPANIES = (
    f"{FUND}, last_f as (select ticker, arg_max(ebitdausd, calendardate) as ebitdausd, arg_max(shareswadil, calendardate) as shareswadil, arg_max(fcfps, calendardate) "
    "as fcfps from f group by 1), companies as (select ticker as company, round(fcfps * shareswadil, 2) as fcf, 0.10::double as wacc, 0.03::double as terminal_growth, "
    "round(ebitdausd * 0.5, 2) as debt, round(ebitdausd * 0.1, 2) as cash, shareswadil as shares from last_f)"
)
PV = "fcf * (" + " + ".join(f"pow((1 + fcf_growth) / (1 + wacc), {i})" for i in range(1, 6)) + ")"
PT = "fcf * pow(1 + fcf_growth, 5) * (1 + terminal_growth) / nullif(wacc - terminal_growth, 0) / pow(1 + wacc, 5)"
PRICE = f"({PV} + {PT} - debt + cash) / nullif(shares, 0)"
DRAWN = (
    f"{COMPANIES}, drawn as (select company, fcf, debt, cash, shares, d.draw::int as draw, 0.8::double * wacc + (1.2::double * wacc - 0.8::double * wacc) * {uniform_sql(chr(39) + 'wacc' + chr(39), 'company', 'draw::int')} as wacc, "
    f"0.5::double * terminal_growth + (least(1.5::double * terminal_growth, 0.9::double * wacc) - 0.5::double * terminal_growth) * {uniform_sql(chr(39) + 'growth' + chr(39), 'company', 'draw::int')} as terminal_growth, "
    f"0.02::double + (0.1::double - 0.02::double) * {uniform_sql(chr(39) + 'fcf' + chr(39), 'company', 'draw::int')} as fcf_growth from companies, range({DRAWS}) d(draw))"
)

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLES = {
    "q_fundamentals": f"with {FUND} select ticker, calendardate, " + ", ".join(f"round({c}, 4) as {c}" for c in ("roic", "fcfps", "ebitdausd", "grossmargin", "shareswadil", "epsusd")) + " from f",
    "q_deltas": f"with {DELTAS} select ticker, calendardate, " + ", ".join(f"round({n}_delta{k}, 6) as {n}_delta{k}" for n in screen.METRICS for k in ("", "_shift1", "_shift2")) + " from ruled",
    "q_rules": f"with {DELTAS} select ticker, calendardate, roic_incr, fcfps_incr, ebitda_incr, grossmarg_incr, sharesout_decr from ruled",
    "q_growth_rate": f"with {DELTAS} select ticker, calendardate, round(growth_rate, 5) as growth_rate from ruled",
    "q_intrinsic_value": f"with {DELTAS} select ticker, calendardate, round(intrinsic_value, 3) as intrinsic_value from ruled",
    "q_criteria_long": f"with {CRITERIA} select ticker, calendardate, criterion, round(intrinsic_value, 3) as intrinsic_value from picks",
    "q_final_tickers": f"with {FINAL} select * from final",
    "q_latest_picks": (
        f"with {CRITERIA} select ticker, calendardate, criterion, round(intrinsic_value, 3) as intrinsic_value from picks where calendardate = (select max(calendardate) "
        "from f)"
    ),
    "q_horizon_avgs": f"with {FINAL}, {DAILY}, fw as ({_forward('final')}) select ticker, start, " + ", ".join(f"round(fwd_{n}, 6) as fwd_{n}" for n in screen.HORIZONS) + " from fw",
    "q_price_rolling_means": (
        f"with {DAILY}, {MEANS} select ticker, date, round(close, 6) as close, round(avg_15, 6) as avg_15, round(avg_30, 6) as avg_30, round(avg_45, 6) as avg_45 "
        "from means"
    ),
    "q_point_in_time": (
        f"with {DAILY}, {MEANS} select ticker, date, round(close, 6) as close, round(avg_15, 6) as avg_15, round(avg_30, 6) as avg_30, round(avg_45, 6) as avg_45 "
        "from means where date <= date '2000-06-30' qualify row_number() over (partition by ticker order by date desc) = 1"
    ),
    "q_screen_join": f"with {FINAL}, {DAILY}, {MEANS}, chosen as (select * from final where calendardate = date '1999-10-01'), fw as ({_forward('chosen')}), latest_row as (select * from means where date <= date '2000-06-30' qualify row_number() over (partition by ticker order by date desc) = 1) select latest_row.ticker as ticker, date, round(close, 6) as close, round(avg_15, 6) as avg_15, round(avg_30, 6) as avg_30, round(avg_45, 6) as avg_45, r_name as sector, criterion, round(intrinsic_value, 6) as intrinsic_value, start, " + ", ".join(f"round(fwd_{n}, 6) as fwd_{n}" for n in screen.HORIZONS) + " from latest_row join chosen on latest_row.ticker = chosen.ticker join nation on n_name = latest_row.ticker join region on n_regionkey = r_regionkey join picks on picks.ticker = latest_row.ticker and picks.calendardate = date '1999-10-01' join fw on fw.ticker = latest_row.ticker",
    "q_sector_filter": (
        f"with {FUND} select ticker, calendardate, round(roic, 6) as roic from f where ticker in (select n_name from nation join region on n_regionkey = r_regionkey "
        "where r_name = 'ASIA')"
    ),
    "q_sectors": "select distinct r_name as sector from nation join region on n_regionkey = r_regionkey",
    "q_prev_bday": (
        "select day, (day - case isodow(day) when 1 then 3 when 7 then 2 else 1 end)::date as previous, strftime(day - 720, '%Y-%m-%d') as since from (select distinct "
        "o_orderdate::date as day from orders)"
    ),
    "q_dcf_mc": (
        f"with {DRAWN}, p as (select company, {PRICE} as price, terminal_growth >= wacc as bad from drawn) select company, round(avg(price), 2) as mean, round(quantile_cont(price, "
        "0.5), 2) as median, round(stddev_pop(price), 2) as std, round(quantile_cont(price, 0.05), 2) as p5, round(quantile_cont(price, 0.95), 2) as p95, (count(*) "
        "filter (where bad))::bigint as n_invalid from p group by 1"
    ),
    "q_dcf_value": (
        f"with {COMPANIES}, c as (select *, 0.06::double as fcf_growth from companies) select company, round({PV}, 2) as pv_fcf, round({PT}, 2) as pv_terminal, "
        f"round({PV} + {PT}, 2) as enterprise_value, round({PRICE}, 2) as price from c"
    ),
    "q_pv_split": (
        f"with {COMPANIES}, c as (select *, 0.06::double as fcf_growth from companies), v as (select company, {PV} as a, {PT} as b from c) select company, 'cash "
        "flows' as part, round(a, 2) as value, round(a / nullif(a + b, 0), 6) as share from v union all select company, 'terminal value', round(b, 2), round(b "
        "/ nullif(a + b, 0), 6) from v"
    ),
    "q_dcf_sensitivity": (
        f"with {COMPANIES}, c as (select company, fcf, debt, cash, shares, 0.06::double as fcf_growth, w::double as wacc, g::double as terminal_growth from companies, "
        f"(values (0.08), (0.09), (0.10), (0.11), (0.12)) ws(w), (values (0.01), (0.02), (0.03), (0.04)) gs(g)) select company, wacc, terminal_growth, round({PRICE}, "
        "2) as price from c"
    ),
    "q_dcf_projection": (
        f"with {COMPANIES} select company, y.y::int as year, round(fcf * pow(1.06::double, y.y), 2) as projected, round(fcf * pow(1.06::double, y.y) / pow(1 + wacc, "
        "y.y), 2) as present from companies, range(1, 6) y(y)"
    ),
    "q_wacc": f"with {COMPANIES} select company, round(shares * 100 / (shares * 100 + debt) * 0.12 + debt / (shares * 100 + debt) * 0.05 * 0.75, 6) as cost from companies",
    "q_historical_metrics": (
        f"with {FUND}, g as (select *, ebitdausd / nullif(lag(ebitdausd) over (partition by ticker order by calendardate), 0) - 1 as g from f) select ticker, count(g) "
        "as periods, round(avg(g), 4) as mean_growth, round(stddev_samp(g), 4) as std_growth, round(arg_max(ebitdausd, calendardate), 4) as last_value from g group "
        "by 1"
    ),
    "q_ratios": (
        f"with {FUND} select ticker, calendardate, round(epsusd * 15 / nullif(epsusd, 0), 5) as pe, round(epsusd * 15 / nullif(ebitdausd / shareswadil, 0), 5) as "
        "pb, round(epsusd * 15 / nullif(fcfps, 0), 5) as ps, round(ebitdausd * 8 / nullif(ebitdausd, 0), 5) as ev_ebitda, round(epsusd * 15 / nullif(epsusd, 0) "
        "/ nullif(roic * 10, 0), 5) as peg from f"
    ),
    "q_dividend_value": (
        f"with {FUND} select ticker, calendardate, round(case when 0.08 > roic / 20 then epsusd * 0.4 * (1 + roic / 20) / (0.08 - roic / 20) end, 3) as ddm, round((ebitdausd "
        "- ebitdausd * 0.5) / nullif(shareswadil, 0), 3) as nav, round(ebitdausd + ebitdausd * 0.1 - ebitdausd * 0.2 - ebitdausd * 0.05 + ebitdausd * 0.03, 3) "
        "as fcfe from f"
    ),
    "q_comparables": (
        f"with {FUND}, m as (select ticker, r_name as sector, calendardate, epsusd, ebitdausd / shareswadil / epsusd as multiple from f join nation on n_name = "
        "ticker join region on n_regionkey = r_regionkey), md as (select sector, median(multiple) as median_multiple from m group by 1) select ticker, m.sector "
        "as sector, calendardate, round(median_multiple, 3) as median_multiple, round(median_multiple * epsusd, 3) as implied_value from m join md on m.sector "
        "= md.sector"
    ),
    "q_page_lines": f"with {LINES} select doc, page, pos, line from lines",
    "q_repeated_lines": f"with {REPEATED} select doc, line, pages from repeated",
    "q_strip_lines": f"with {STRIPPED} select doc, page, pos, line from stripped",
    "q_headings": f"with {LINES}, x as (select doc, page, pos, [" + ", ".join(f"'{h}'" for h in HEADS) + f"][pos % {len(HEADS)} + 1] || line as x from lines) select doc, page, pos, {_head('x')} as marked from x",
    "q_repeated_rule": (
        "with lines as (select strftime(ts, '%Y-%m-%d %H') as doc, event_id as page, event_type as line from events union all select strftime(ts, '%Y-%m-%d %H'), "
        "event_id, 'user ' || (user_id % 3) from events), n as (select doc, count(distinct page) as of from lines group by 1), r as (select doc, line, count(distinct "
        "page) as pages from lines group by 1, 2) select doc, line, pages from r join n using (doc) where of >= 3 and pages >= greatest(3, floor(of * 0.6))"
    ),
    "q_table_scan": "select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from orders where o_orderstatus in ('F', 'P') and o_orderdate <= date '1997-06-30'",
    "q_file_scan": "select o_orderkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice from orders where o_orderstatus in ('F', 'P') and o_orderdate <= date '1997-06-30'",
    "q_asof_prices": (
        f"with {FUND}, {DAILY} select f.ticker as ticker, calendardate, round(roic, 6) as roic, round(case when p.date >= calendardate - interval 7 day then close end, 6) as close, "
        "case when p.date >= calendardate - interval 7 day then p.date end as price_date from f asof left join daily p on f.ticker = p.ticker and f.calendardate >= p.date"
    ),
    "q_asof_bars": (
        f"with {BARS} select event_id, e.ts as at, event_type as ticker, round(value, 6) as value, round(close, 6) as close, b.ts as bar_end "
        "from events e asof left join (select ticker, ts + interval 1 hour as ts, close from bars) b on e.event_type = b.ticker and e.ts > b.ts"
    ),
    "q_revenue_order": (
        f"with {FUND} select ticker, round(ebitdausd, 2) as ebitdausd, (row_number() over (order by ebitdausd desc, ticker))::int as place from f where calendardate "
        "= (select max(calendardate) from f) qualify place <= 10"
    ),
    "q_point_in_time_exact": (
        f"with {DAILY}, {MEANS} select ticker, date, round(close, 6) as close, round(avg_15, 6) as avg_15, round(avg_30, 6) as avg_30, round(avg_45, 6) as avg_45 "
        "from means where date = date '2000-06-30'"
    ),
    "q_markdown": f"with {STRIPPED}, p as (select doc, page, {_strip(f"string_agg({_head('line')}, chr(10) order by pos)")} as text from stripped group by 1, 2), "
    "t as (select source as doc, doc_id as page, '| page | chars |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | ' || length(coalesce(text, '')) || ' |' as tab from documents where doc_id % 10 = 0), "
    "parts as (select source as doc, doc_id as page, 0 as place, p.text as part from documents join p on p.doc = source and p.page = doc_id where p.text <> '' union all "
    "select doc, page, 1, '' from t union all select doc, page, 2, tab from t union all select source, doc_id, 3, '' from documents), "
    f"m as (select doc, {_strip('string_agg(part, chr(10) || chr(10) order by page, place)')} || chr(10) as markdown from parts group by 1) select doc, md5(markdown) as digest, length(markdown)::bigint as chars from m",
    "q_cid_pages": r"select source as doc, doc_id as page from documents where regexp_matches(coalesce(text, '') || case when doc_id % 7 = 0 then '(cid:' || doc_id || ')' when doc_id % 5 = 0 then '(cid: 5) cid:6' else '' end, '\(cid:[0-9]+\)')",
    "q_low_text_pages": (
        "with a as (select source as doc, avg(length(coalesce(text, ''))) as a from documents group by 1) select doc, doc_id as page from documents join a on source "
        "= doc where length(coalesce(text, '')) < a * 0.15 and a > 200"
    ),
    "q_md_table": "select conv_id, '| role | text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(" + _strip("role") + ", chr(10), ' ') || ' | ' || replace(" + _strip("coalesce(text, '')") + ", chr(10), ' ') || ' |', chr(10) order by turn) as markdown from conversations group by 1",
    "q_quality_report": (
        "with a as (select source as doc, count(*) as pages, avg(length(coalesce(text, ''))) as avg_chars from documents group by 1), l as (select doc, string_agg(doc_id::varchar, "
        "',' order by doc_id) as low, string_agg(doc_id::varchar, ', ' order by doc_id) as shown from documents join a on source = doc where length(coalesce(text, "
        "'')) < avg_chars * 0.15 and avg_chars > 200 group by 1), c as (select source as doc, string_agg(doc_id::varchar, ',' order by doc_id) as cid, string_agg(doc_id::varchar, "
        "', ' order by doc_id) as shown from documents where regexp_matches(text, '\\(cid:\\d+\\)') group by 1) select a.doc as doc, pages, round(avg_chars, 4) "
        "as avg_chars, 0::bigint as n_tables, coalesce(low, '') as low_text_pages, coalesce(cid, '') as cid_pages, concat_ws('; ', 'little text on pages ' || l.shown, "
        "'broken glyphs on pages ' || c.shown) as warnings from a left join l on a.doc = l.doc left join c on a.doc = c.doc"
    ),
    "q_skip_done": "select doc_id, source from documents where doc_id not in (select doc_id from documents where source = 'src0')",
    "q_tail_rows": f"with {RETS} select ticker, ts, round(ret, 8) as ret from rets qualify row_number() over (partition by ticker order by ts desc) <= 7",
}
