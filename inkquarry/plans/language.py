"""Queries of the form calculation language, field formats and node paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import af, geometry, som, text
from ..functions import formcalc as fc
from ..operators import shred
from ..sources.tables import table
from .nested import _NODES, _records
from .registry import Registry

R = Registry()
c = F.col


def _run(df, keys: list[str], scripts: dict[str, str], env: dict, lists: dict | None = None):
    """Scripts as columns: the language itself is what is queried."""
    return df.select(*keys, *(fc.formcalc(s, env, lists).alias(k) for k, s in scripts.items()))


@R.query("fc_arithmetic", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, c_acctbal - 7 * trunc(c_acctbal / 7) AS d, round(abs(c_acctbal) + 0.0001, 1) * sign(c_acctbal) AS e, 3.0::DOUBLE AS n, c_acctbal + c_nationkey + 12 AS s, (c_acctbal + c_nationkey) / 2 AS m, greatest(c_acctbal, c_nationkey) AS hi, least(c_acctbal, c_nationkey) AS lo FROM (SELECT c_custkey, CAST(trunc(c_acctbal) AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer)")
def fc_arithmetic(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.when(c("c_acctbal") < 0, F.ceil("c_acctbal")).otherwise(F.floor("c_acctbal")).cast("double").alias("bal"), c("c_nationkey").cast("double").alias("nation"), F.lit("12abc").alias("txt"), F.lit(None).cast("string").alias("none"))
    scripts = {"a": "Abs(bal)", "b": "Ceil(bal)", "c": "Floor(bal)", "d": "Mod(bal, 7)", "e": "Round(bal, 1)", "n": 'Count(bal, nation, txt, none, "")', "s": "Sum(bal, nation, txt, none)", "m": "Avg(bal, nation, none)", "hi": "Max(bal, nation, none)", "lo": "Min(bal, nation, none)"}
    return _run(x, ["c_custkey"], scripts, {k: c(k) for k in ("bal", "nation", "txt", "none")})


@R.query("fc_coercion", """SELECT c_custkey, c_custkey + 5.0::DOUBLE AS prefix, 0.0::DOUBLE AS word, CAST(NULL AS DOUBLE) AS both_null, c_custkey::DOUBLE AS one_null, CASE WHEN c_custkey = 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS same, 1.0::DOUBLE AS nulls, 1.0::DOUBLE AS unequal, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS truthy,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey // 2 AS VARCHAR) ELSE CAST(c_custkey // 2 AS VARCHAR) || '.5' END AS shown FROM customer""")  # fmt: skip
def fc_coercion(spark, d):
    k = c("c_custkey").cast("string")
    env = {"k": k, "pre": F.concat(k, F.lit("abc")), "none": F.lit(None).cast("string"), "half": F.lit("0.5"), "m": (c("c_custkey") % 2).cast("string")}
    scripts = {"prefix": "pre + 5", "word": '"abc" * 3', "both_null": "none + none", "one_null": "none + k", "same": "k == 7.0", "nulls": "none == null", "unequal": "none <> k", "truthy": 'if (m == 0) then "yes" else "no" endif'}
    out = _run(table(spark, d, "customer"), ["c_custkey"], scripts, env)
    return out.withColumn("shown", fc.fc_str(c("c_custkey") / 2, number=True))


@R.query("fc_logic", """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS choose, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS has, CASE WHEN c_custkey IN (3, 5, 8) THEN 1.0 ELSE 0.0 END::DOUBLE AS one, CASE WHEN c_custkey BETWEEN 5 AND 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS within,
  1.0::DOUBLE AS here, 0.0::DOUBLE AS gone FROM customer""")  # fmt: skip
def fc_logic(spark, d):
    k = c("c_custkey")
    env = {"k": k.cast("string"), "m": (k % 4).cast("string"), "blank": F.when(k % 2 == 0, "  ").otherwise("x")}
    scripts = {"choose": 'Choose(m, "a", "b", "c")', "has": "HasValue(blank)", "one": 'Oneof(k, 3, "5.0", 8)', "within": "Within(k, 5, 20)", "here": "Exists(blank)", "gone": "Exists(nothing)"}
    return _run(table(spark, d, "customer"), ["c_custkey"], scripts, env)


@R.query("fc_strings", """SELECT p_partkey, p_name[1:3] AS l, right(p_name, 2) AS r, length(p_name)::DOUBLE AS n, lower(upper(p_name)) AS lo, upper(p_name) AS up, p_name || '|' AS lt, '|' || p_name AS rt, '[   ]' AS sp, lpad(CAST(p_size AS VARCHAR), 6, ' ') AS st, '*' || '*' AS wide, instr(p_name, 'a')::DOUBLE AS at, 0.0::DOUBLE AS at_none,
  replace(p_name, 'a', 'AA') AS rep, p_name[2:4] AS sub, p_name[1:2] || 'xy' || p_name[5:] AS stuff FROM part""")  # fmt: skip
def fc_strings(spark, d):
    n = c("p_name")
    env = {"n": n, "size": c("p_size"), "left": F.concat(F.lit("  \t"), n), "right": F.concat(n, F.lit(" \n "))}
    scripts = {"l": "Left(n, 3)", "r": "Right(n, 2)", "n": "Len(n)", "lo": "Lower(Upper(n))", "up": "Upper(n)", "lt": 'Concat(Ltrim(left), "|")', "rt": 'Concat("|", Rtrim(right))', "sp": 'Concat("[", Space(3), "]")', "st": "Str(size, 6, 0)", "wide": "Str(123456, 2, 0)", "at": 'At(n, "a")', "at_none": 'At(n, "")', "rep": 'Replace(n, "a", "AA")', "sub": "Substr(n, 2, 3)", "stuff": 'Stuff(n, 3, 2, "xy")'}
    return _run(table(spark, d, "part"), ["p_partkey"], scripts, env)


@R.query("fc_codes", """SELECT p_partkey, replace(replace(p_name, ' ', '%20'), '&', '%26') || '%3C%26%3E~' AS url, p_name || '<&>~' AS back, p_name || '&lt;&amp;&gt;~' AS html, p_name || '<&>~' AS html_back FROM part""")
def fc_codes(spark, d):
    env = {"n": F.concat("p_name", F.lit("<&>~"))}
    scripts = {"url": 'Encode(n, "url")', "back": 'Decode(Encode(n, "url"), "url")', "html": 'Encode(n, "html")', "html_back": 'Decode(Encode(n, "html"), "html")'}
    return _run(table(spark, d, "part"), ["p_partkey"], scripts, env)


@R.query("fc_calendar", """SELECT o_orderkey, strftime(d, '%d/%m/%Y') AS shown, n AS day, n AS iso, strftime(d, '%Y-%m-%d') AS parsed, strftime(d, '%d.%m.%y') AS pictured, 'M/D/YY' AS short, 'MMMM D, YYYY' AS long, 'HH:MM:SS' AS clock, CASE WHEN o_orderkey % 86400 = 0 THEN '00:00:00' ELSE strftime(TIMESTAMP '2000-01-01' + to_seconds(o_orderkey % 86400), '%H:%M:%S') END AS time, (o_orderkey % 86400 * 1000)::DOUBLE AS ms
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, date_diff('day', DATE '1899-12-31', CAST(o_orderdate AS DATE))::DOUBLE AS n FROM orders)""")  # fmt: skip
def fc_calendar(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    env = {"day": day, "dm": F.date_format("o_orderdate", "dd/MM/yyyy"), "n": F.datediff("o_orderdate", F.lit("1899-12-31").cast("date")), "ms": (c("o_orderkey") % 86400 * 1000)}
    scripts = {"shown": 'Num2Date(n, "DD/MM/YYYY")', "day": 'Date2Num(dm, "DD/MM/YYYY")', "iso": "IsoDate2Num(day)", "parsed": 'Parse("DD/MM/YYYY", dm)', "pictured": 'Format("DD.MM.YY", n)', "short": "DateFmt(1)", "long": "LocalDateFmt(3)", "clock": "TimeFmt(1)", "time": "Num2Time(ms)", "ms": "Time2Num(Num2GMTime(ms))"}
    return _run(table(spark, d, "orders"), ["o_orderkey"], scripts, env)


@R.query("fc_pictures", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) AS money, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:.2f}', abs(c_acctbal)) AS plain, c_acctbal AS back, CAST(NULL AS DOUBLE) AS nothing FROM customer""")
def fc_pictures(spark, d):
    env = {"b": c("c_acctbal")}
    scripts = {"money": 'Format("$zz,zz9.99", b)', "plain": 'Format("99.99", b)', "back": 'Parse("$zz,zz9.99", Format("$zz,zz9.99", b))', "nothing": 'Parse("99", "none")'}
    return _run(table(spark, d, "customer"), ["c_custkey"], scripts, env)


@R.query("fc_finance", """SELECT o_orderkey, round(ln(1 + p * 2 * 0.01 / (p / 10)) / ln(1.01), 6) AS term, round(ln(2) / ln(1.05), 6) AS cterm, round(pow(2, 1 / 8.0) - 1, 8) AS rate, round(p * 0.01, 4) AS interest, round(p / 12 - p * 0.01, 4) AS principal, true AS apr FROM (SELECT o_orderkey, o_totalprice AS p FROM orders)""")
def fc_finance(spark, d):
    p = c("o_totalprice")
    env = {"p": p, "twice": p * 2, "tenth": p / 10, "part": p / 12}
    scripts = {"term": "Term(tenth, 0.01, twice)", "cterm": "CTerm(0.05, twice, p)", "rate": "Rate(twice, p, 8)", "interest": "IPmt(p, 0.12, part, 1, 1)", "principal": "PPmt(p, 0.12, part, 1, 1)", "apr": "Apr(p, Pmt(p, 0.01, 24), 24)"}
    out = _run(table(spark, d, "orders"), ["o_orderkey"], scripts, env)
    places = {"term": 6, "cterm": 6, "rate": 8, "interest": 4, "principal": 4}
    return out.select("o_orderkey", *(F.round(k, n).alias(k) for k, n in places.items()), (F.abs(c("apr") - 0.12) < 1e-9).alias("apr"))


@R.query("fc_units", "SELECT p_partkey, (['in', 'mm', 'cm', 'pt'])[p_partkey % 4 + 1] AS unit, round(p_size * ([72.0, 72 / 25.4, 72 / 2.54, 1.0])[p_partkey % 4 + 1], 6) AS points FROM part")
def fc_units(spark, d):
    units = F.array(*map(F.lit, ("in", "mm", "cm", "pt")))
    env = {"m": F.concat("p_size", F.get(units, (c("p_partkey") % 4).cast("int")))}
    out = _run(table(spark, d, "part"), ["p_partkey"], {"unit": "UnitType(m)", "points": 'UnitValue(m, "pt")'}, env)
    return out.withColumn("points", F.round("points", 6))


@R.query("fc_loops", "SELECT c_custkey, (c_custkey * 10)::DOUBLE AS total, (c_custkey + 6)::DOUBLE AS each, (c_custkey * c_custkey + 1)::DOUBLE AS squared FROM customer")
def fc_loops(spark, d):
    env = {"k": c("c_custkey")}
    scripts = {
        "total": "var t = 0\nfor i = 1 upto 4 do t = t + k * i endfor\nt", "each": "var t = k\nforeach x in (1, 2, 3) do t = t + x endfor\nt",
        "squared": "func square(x) do x * x endfunc\nfunc more(x) do square(x) + 1 endfunc\nmore(k)",
    }
    return _run(table(spark, d, "customer"), ["c_custkey"], scripts, env)


@R.query("fc_lists", "SELECT l_orderkey, sum(l_quantity) AS total, max(l_quantity) AS most, count(*)::DOUBLE AS lines, arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS first FROM lineitem GROUP BY l_orderkey")
def fc_lists(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"]).alias("qty"))
    return _run(q, ["l_orderkey"], {"total": "Sum(qty[*])", "most": "Max(qty[*])", "lines": "Count(qty[*])", "first": "qty[0] + 0"}, {}, {"qty": c("qty")})


# node paths


def _nodes(spark, d):
    x, plan = _records(spark, d)
    return shred.shred(x, "rec_id", "raw", shred.XFA, plan, "node", "node", ["value"], "received_at")


_FOUND = _NODES.removesuffix("SELECT rec_id, som, parent_som FROM p")


@R.query("som_find", _FOUND + r"SELECT rec_id, som AS path FROM p WHERE regexp_matches(som, '^[^.]+\.(?:[^.]+\.)*row\[\d+\]\.qty\[\d+\]$')")
def som_find(spark, d):
    """All quantities of all rows, at any depth."""
    return som.find(_nodes(spark, d), "$form..row[*].qty[*]").select("rec_id", "path")


@R.query("som_resolve", _FOUND + """SELECT n.rec_id, n.som AS context, 'total' AS name, (SELECT arg_max(t.som, length(t.som)) FROM p t WHERE t.rec_id = n.rec_id AND (t.som = 'total[0]' OR (ends_with(t.som, '.total[0]') AND (n.som = t.parent_som OR starts_with(n.som, t.parent_som || '.'))))) AS found FROM p n""")
def som_resolve(spark, d):
    """What ``total`` means at every node: the nearest one in scope."""
    n = _nodes(spark, d)
    return som.resolve(n, n.select("rec_id", c("path").alias("context"), F.lit("total").alias("name")))


# geometry and formats that only literals tested so far


@R.query("matrix_ops", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 + 5 AS x, l_tax * 3 - 1 AS y, round(l_quantity, 6) AS bx, round(l_tax, 6) AS by FROM lineitem")
def matrix_ops(spark, d):
    m = geometry.compose(F.array(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 0.0, 0.0))), F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 5.0, -1.0))))
    p = geometry.apply(m, c("l_quantity"), c("l_tax"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", p["x"].alias("x"), p["y"].alias("y"))
    back = geometry.apply(geometry.invert(m), c("x"), c("y"))
    return x.withColumn("bx", F.round(back["x"], 6)).withColumn("by", F.round(back["y"], 6))


@R.query("rect_containment", "SELECT doc_id, page, ord, rect[1] >= 50 AND rect[2] >= 50 AND rect[3] <= 500 AND rect[4] <= 700 AS inside FROM (SELECT DISTINCT ON (doc_id, page, ord) * FROM words) WHERE rect IS NOT NULL")
def rect_containment(spark, d):
    w = table(spark, d, "words").where("rect is not null").dropDuplicates(["doc_id", "page", "ord"])
    return w.select("doc_id", "page", "ord", geometry.contains(F.array(*map(F.lit, (50.0, 50.0, 500.0, 700.0))), c("rect")).alias("inside"))


@R.query("segment_crossings", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_size::DOUBLE END AS x, CASE WHEN p_size <= 20 THEN 10.0 END::DOUBLE AS y FROM part")
def segment_crossings(spark, d):
    at = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    s = c("p_size")
    p = geometry.intersection(at(s, 0), at(s, 20), at(F.lit(0), 10), at(F.lit(20), 10))
    return table(spark, d, "part").select("p_partkey", p["x"].alias("x"), p["y"].alias("y"))


@R.query("polygon_perimeter", "SELECT doc_id, page, ord, round(2 * (abs(rect[3] - rect[1]) + abs(rect[4] - rect[2])), 3) AS length FROM (SELECT DISTINCT ON (doc_id, page, ord) * FROM words) WHERE rect IS NOT NULL")
def polygon_perimeter(spark, d):
    r = c("rect")
    corners = F.array(*(F.struct(r[i].alias("x"), r[j].alias("y")) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))))
    w = table(spark, d, "words").where("rect is not null").dropDuplicates(["doc_id", "page", "ord"])
    return w.select("doc_id", "page", "ord", F.round(geometry.perimeter(corners), 3).alias("length"))


@R.query("luhn_checks", "SELECT c_custkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(n[i] AS INTEGER) * 2) // 10 + (CAST(n[i] AS INTEGER) * 2) % 10 ELSE CAST(n[i] AS INTEGER) END)) % 10 = 0 AS ok FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 4000000000000000 AS VARCHAR), 16, '0') AS n FROM customer)")
def luhn_checks(spark, d):
    n = F.lpad((c("c_custkey") * 7919 + 4000000000000000).cast("string"), 16, "0")
    return table(spark, d, "customer").select("c_custkey", text.luhn(n).alias("ok"))


@R.query("recalculated", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_tax AS net, round(l_quantity * l_tax + l_discount, 6) AS gross, round((l_quantity + l_tax + l_discount) / 3, 6) AS mean, least(l_quantity, l_tax) AS low FROM lineitem")
def recalculated(spark, d):
    env = {k: c(k).cast("string") for k in ("l_quantity", "l_tax", "l_discount")}
    out = af.recalculate(env, {"gross": ("SUM", ["net", "l_discount"]), "net": ("PRD", ["l_quantity", "l_tax"]), "mean": ("AVG", list(env)), "low": ("MIN", ["l_quantity", "l_tax"])})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", out["net"].alias("net"), F.round(out["gross"], 6).alias("gross"), F.round(out["mean"], 6).alias("mean"), out["low"].alias("low"))


@R.query("af_numbers", """SELECT c_custkey, c_acctbal AS typed, -abs(c_acctbal) AS bracketed, c_acctbal AS european, format('{:.1f}', abs(round(c_acctbal)) / 10 * 100) || '%' AS percent, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || replace(format('{:,.2f}', abs(c_acctbal)), ',', '''') AS swiss,
  'No. ' || c_custkey || ': ' || CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{:,.2f}', abs(c_acctbal)) || ' 100%' AS printed FROM customer""")  # fmt: skip
def af_numbers(spark, d):
    b = c("c_acctbal")
    plain, grouped = F.format_string("%.2f", b), F.format_string("%,.2f", F.abs(b))
    european = F.translate(F.format_string("%,.2f", b), ",.", ".,")
    return table(spark, d, "customer").select(
        "c_custkey", af.make_number(F.concat(F.lit("$ "), plain)).alias("typed"), af.make_number(F.concat(F.lit("("), grouped, F.lit(")"))).alias("bracketed"), af.make_number(european).alias("european"),
        af.percent_format(F.abs(F.round(b)) / 10, 1, 1).alias("percent"), af.number_format(b, 2, 4).alias("swiss"), af.printf("No. %d: %,0.2f 100%%", c("c_custkey"), b).alias("printed"),
    )


@R.query("af_dates", "SELECT o_orderkey, d AS slash, d AS dotted, d AS named, d AS iso, strftime(d, '%d.%m.%y') AS shown, strftime(d, '%B %-d, %Y') AS long FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def af_dates(spark, d):
    t = c("o_orderdate")
    f = lambda p: F.date_format(t, p)
    return table(spark, d, "orders").select(
        "o_orderkey", af.parse_date(f("M/d/yyyy")).alias("slash"), af.parse_date(f("dd.MM.yyyy"), "dmy").alias("dotted"), af.parse_date(f("d MMMM yyyy")).alias("named"), af.parse_date(f("yyyy-MM-dd")).alias("iso"),
        af.date_format(t, "dd.mm.yy").alias("shown"), af.date_format(t, "mmmm d, yyyy").alias("long"),
    )


@R.query("af_keystrokes", "SELECT c_custkey, c_custkey % 3 <> 0 AS number_ok, CASE WHEN c_custkey % 3 = 0 THEN 'no number' END AS number_error, c_custkey % 2 = 0 AS zip_ok, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS zip, substr(n, 1, 3) || '-' || substr(n, 4, 2) AS printed FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS n FROM customer)")
def af_keystrokes(spark, d):
    k = c("c_custkey")
    number = af.keystroke(F.when(k % 3 == 0, "x").otherwise(k.cast("string")), "number")
    zips = af.keystroke(F.when(k % 2 == 0, F.lpad(k.cast("string"), 5, "0")).otherwise("abc"), "special", special=0)
    return table(spark, d, "customer").select("c_custkey", number["ok"].alias("number_ok"), number["error"].alias("number_error"), zips["ok"].alias("zip_ok"), zips["value"].alias("zip"), af.printx(F.lpad(k.cast("string"), 9, "0"), "999-99").alias("printed"))


@R.query("fc_uuid", "SELECT c_custkey, md5('1') AS plain, md5('1')[1:8] || '-' || md5('1')[9:12] || '-' || md5('1')[13:16] || '-' || md5('1')[17:20] || '-' || md5('1')[21:] AS grouped FROM customer")
def fc_uuid(spark, d):
    return _run(table(spark, d, "customer"), ["c_custkey"], {"plain": "Uuid()", "grouped": "Uuid(1)"}, {})


@R.query("af_display", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'none' ELSE CASE WHEN c_acctbal < 0 THEN '(' ELSE '' END || format('{:,.2f}', abs(c_acctbal)) || ' EUR' || CASE WHEN c_acctbal < 0 THEN ')' ELSE '' END END AS money, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS zip, '04.03.31' AS day FROM customer")
def af_display(spark, d):
    k = c("c_custkey")
    value = F.when(k % 10 == 0, "  ").when(k % 10 == 1, "none").otherwise(F.format_string("%.2f", c("c_acctbal")))
    specs = {n: af.recognise(s) for n, s in (("money", 'AFNumber_Format(2, 0, 2, 0, " EUR", false);'), ("zip", "AFSpecial_Format(0);"), ("day", 'AFDate_FormatEx("dd.mm.yy");'))}
    return table(spark, d, "customer").select("c_custkey", af.display(value, specs["money"]).alias("money"), af.display(F.lpad(k.cast("string"), 5, "0"), specs["zip"]).alias("zip"), af.display(F.lit("3/4/2031"), specs["day"]).alias("day"))
