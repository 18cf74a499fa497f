"""Queries that send files through each converter of a kind and back, and through what the batch and planner parts offer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import sql as S
from quern.functions import text as T
from quern.operators import batch
from quern.operators.convert import CONVERTERS, convert, convert_along, convert_paths
from quern.plans import catalogue, planner
from quern.queries import CUSTOMER_CSV, _customer_files, _files, _values, query, table


def _edges(kinds: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(s, t) for s in kinds for t in kinds if (s, t) in CONVERTERS]


def _through(files: DataFrame, pairs: list[tuple[str, str]], home: str, **options) -> DataFrame:
    """(edge, path, content): from home to an edge's source, along the edge, and home again. A file's edges are one task's, so
    that they share steps; files are dealt out first, as a table may be stored in fewer pieces than there are cores."""
    files = files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path")
    return convert_paths(files, {f"{s} {t}": [(home, s)] * (s != home) + [(s, t)] + [(t, home)] * (t != home) for s, t in pairs}, **options)


def _expected(pairs: list[tuple[str, str]], sql: str) -> str:
    return f"select edge, path, content, cast(null as varchar) as error from ({sql}) cross join (values {_values([(f'{s} {t}',) for s, t in pairs])}) e(edge)"


def _as_text(frame: DataFrame) -> DataFrame:
    return frame.withColumn("content", F.col("content").cast("string"))


ROWS = _edges(("csv", "tsv", "json", "jsonl", "xlsx", "ods", "markdown"))
ROWS = [(s, t) for s, t in ROWS if s == "csv" or ("csv", s) in CONVERTERS]


@query(_expected(ROWS, CUSTOMER_CSV))
def row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_through(_customer_files(spark, sf_dir), ROWS, "csv"))


TREES = _edges(("json", "toml", "yaml", "xml"))


@query(_expected(TREES, """select cast(event_id as varchar) as path, '{"e":{"kind":"' || event_type || '","user":"u' || user_id || '","list":["a' || event_id || '","b & <c>"]}}' || chr(10) as content from events where true"""))
def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    content = F.concat(F.lit('{"e":{"kind":"'), "event_type", F.lit('","user":"u'), "user_id", F.lit('","list":["a'), "event_id", F.lit('","b & <c>"]}}'))
    return _as_text(_through(_files(e, e.event_id, content), TREES, "json"))


DOCUMENTS = _edges(("text", "markdown", "html", "markdown-json", "docx", "odt", "rtf", "epub"))
DOCUMENTS = [(s, t) for s, t in DOCUMENTS if (s == "text" or ("text", s) in CONVERTERS) and (t == "text" or (t, "text") in CONVERTERS)]
PDFS = [(s, t) for s, t in _edges(("text", "markdown", "html", "docx", "odt", "rtf", "epub", "pdf")) if "pdf" in (s, t)]
_SUPPLIER = "select cast(s_suppkey as varchar) as path, s_name || ' says 1 < 2 & more.' || {0} || 'Nation ' || s_nationkey || ' is its home.' || {1} as content from supplier"


def _supplier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier")
    return _files(p, p.s_suppkey, F.concat("s_name", F.lit(" says 1 < 2 & more.\n\nNation "), "s_nationkey", F.lit(" is its home.\n")))


@query(_expected(DOCUMENTS, _SUPPLIER.format("chr(10) || chr(10)", "chr(10)")))
def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(_through(_supplier_texts(spark, sf_dir), DOCUMENTS, "text"))


@query(_expected(PDFS, _SUPPLIER.format("' '", "''")))
def pdf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of pages, whatever stands between them."""
    return _as_text(_through(_supplier_texts(spark, sf_dir), PDFS, "text")).withColumn("content", F.trim(F.regexp_replace("content", r"\s+", " ")))


_PIXEL_KINDS = ("pgm", "ppm", "pam", "png", "bmp", "qoi", "tga", "tiff", "ico", "webp", "pdf")
PIXELS = [(s, t) for s, t in _edges(_PIXEL_KINDS)]
FLAT = [(s, t) for s, t in _edges((*_PIXEL_KINDS, "jpeg")) if "jpeg" in (s, t)]
BLACK = [(s, t) for s, t in _edges((*_PIXEL_KINDS, "pbm")) if "pbm" in (s, t)]
_GRAY = {"pattern": "(n_nationkey * 7 + k * 13) % 256", "flat": "(n_nationkey * 10) % 256", "black": "((n_nationkey + k) % 3 % 2) * 255"}


def _pictures(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """An 8 x 8 gray picture (PGM) for each nation."""
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    shades = rows.select("n_nationkey", "k", F.lpad(F.hex(F.expr(f"cast({_GRAY[kind]} as int)")), 2, "0").alias("x"))
    body = shades.groupBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]), "").alias("x"))
    return body.select(F.col("n_nationkey").cast("string").alias("path"), F.unhex(F.concat(F.hex(F.lit("P5\n8 8\n255\n").cast("binary")), "x")).alias("content"))


def _picture_sql(kind: str, pairs: list[tuple[str, str]]) -> str:
    return _expected(pairs, f"select cast(n_nationkey as varchar) as path, '50350A3820380A3235350A' || (select string_agg(lpad(format('{{:X}}', {_GRAY[kind]}), 2, '0'), '' order by k) from range(64) t(k)) as content from nation")


def _picture_edges(spark: SparkSession, sf_dir: str, kind: str, pairs: list[tuple[str, str]]) -> DataFrame:
    return _through(_pictures(spark, sf_dir, kind), pairs, "pgm").withColumn("content", F.hex("content"))


@query(_picture_sql("pattern", PIXELS))
def image_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture_edges(spark, sf_dir, "pattern", PIXELS)


@query(_picture_sql("flat", FLAT))
def jpeg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of one shade each, which JPEG keeps."""
    return _picture_edges(spark, sf_dir, "flat", FLAT)


@query(_picture_sql("black", BLACK))
def bitmap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picture_edges(spark, sf_dir, "black", BLACK)


ROMS = _edges(("z64", "v64", "n64"))
_WORD = "lpad(format('{:X}', (p_partkey * 2654435761 + 305419896) % 4294967296), 8, '0')"
_ORDERS = {"z64": "{0}", "v64": "{0}[3:4] || {0}[1:2] || {0}[7:8] || {0}[5:6]", "n64": "{0}[7:8] || {0}[5:6] || {0}[3:4] || {0}[1:2]"}


@query(" union all ".join(f"select '{s} {t}' as edge, cast(p_partkey as varchar) as path, {_ORDERS[t].format('w')} as content from (select p_partkey, {_WORD} as w from part)" for s, t in ROMS))
def rom_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    word = F.unhex(F.lpad(F.hex((F.col("p_partkey") * F.lit(2654435761) + 305419896) % F.lit(4294967296)), 8, "0"))
    out = None
    for s, t in ROMS:
        hops = [("z64", s)] * (s != "z64") + [(s, t)]
        got = convert_along(_files(p, p.p_partkey, word), hops).select(F.lit(f"{s} {t}").alias("edge"), "path", F.hex("content").alias("content"))
        out = got if out is None else out.unionByName(got)
    return out


# what breaks, what is lost

_BROKEN = [
    ("json", "yaml", b'{"a":'), ("json", "csv", b"7"), ("toml", "json", b"a = ="), ("yaml", "json", b"a: [1"), ("xml", "json", b"<a><b></a>"), ("csv", "json", b'a,b\n"1'), ("xlsx", "csv", b"PK\x03\x04 no"),
    ("ods", "csv", b"PK\x03\x04"), ("docx", "text", b"PK\x03\x04zz"), ("odt", "text", b""), ("epub", "text", b"PK"), ("rtf", "text", b"no rtf"), ("pdf", "text", b"%PDF-1.7\n1 0 obj"), ("png", "bmp", b"\x89PNG\r\n\x1a\nxx"),
    ("jpeg", "png", b"\xff\xd8\xff\xe0"), ("bmp", "png", b"BM12"), ("qoi", "png", b"qoif\0\0"), ("tiff", "png", b"II*\0\x08\0\0\0"), ("tga", "png", b"\0\0\x02"), ("pgm", "png", b"P5\n4 4\n255\nab"), ("ico", "png", b"\0\0\1\0\1\0"),
    ("n64", "z64", b"\x40\x12\x37"), ("markdown-json", "html", b"[1"), ("jsonl", "csv", b'{"a":1}\n{'), ("json", "toml", b"[" * 100_000),
]


@query(f"select n_nationkey, k, true as refused from nation cross join (values {_values([(k,) for k in range(len(_BROKEN))])}) b(k)")
def convert_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files give error rows, none ends the job."""
    n, out = table(spark, sf_dir, "nation"), None
    for k, (s, t, content) in enumerate(_BROKEN):
        files = n.select(F.col("n_nationkey").cast("string").alias("path"), F.lit(bytearray(content)).alias("content"))
        got = convert_along(files, [(s, t)]).select(F.col("path").cast("int").alias("n_nationkey"), F.lit(k).alias("k"), F.col("error").isNotNull().alias("refused"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""select cast(c_custkey as varchar) as path, 'a,b,c' || chr(10) || '1,' || c_custkey || ',' || chr(10) || ',x,' || c_nationkey || chr(10) as content, 2 as n_losses from customer""")
def jsonl_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects' keys in the order in which they first come up; what is missing is empty, types become text."""
    c = table(spark, sf_dir, "customer")
    content = F.concat(F.lit('{"a":"1","b":'), "c_custkey", F.lit('}\n{"b":"x","c":"'), "c_nationkey", F.lit('"}\n'))
    got = convert(_files(c, c.c_custkey, content), "jsonl", "csv")
    return got.select("path", F.col("content").cast("string").alias("content"), F.size("losses").alias("n_losses"))


@query("""select cast(c_custkey as varchar) as path, case c_custkey % 3 when 0 then '{"a":"1"}' when 1 then '{"a":"1","b":"2"}' else '{"a":"1","b":"2"}' end || chr(10) as content,
          case when c_custkey % 3 = 0 then 1 else 0 end as n_warnings, case when c_custkey % 3 = 2 then 1 else 0 end as n_losses from customer""")
def ragged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short records warn, long ones lose cells."""
    c = table(spark, sf_dir, "customer")
    row = F.element_at(F.array(F.lit("1"), F.lit("1,2"), F.lit("1,2,3")), (F.col("c_custkey") % 3 + 1).cast("int"))
    got = convert(_files(c, c.c_custkey, F.concat(F.lit("a,b\n"), row, F.lit("\n"))), "csv", "jsonl")
    return got.select("path", F.col("content").cast("string").alias("content"), F.size("warnings").alias("n_warnings"), F.size("losses").alias("n_losses"))


@query("""select cast(n_nationkey as varchar) as path, part_index, case part_index when 0 then 'First' else 'Second' end as part_name, case part_index when 0 then 'a,b' || chr(10) || n_name || ',1' || chr(10) else 'c' || chr(10) || n_regionkey || chr(10) end as content
          from nation cross join (values (0), (1)) p(part_index)""")
def tables_per_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document's tables as parts, named by the headings before them."""
    n = table(spark, sf_dir, "nation")
    content = F.concat(F.lit("# First\n\n| a | b |\n| --- | --- |\n| "), "n_name", F.lit(" | 1 |\n\nText.\n\n## Second\n\n| c |\n| --- |\n| "), "n_regionkey", F.lit(" |\n"))
    got = convert(_files(n, n.n_nationkey, content), "markdown", "csv")
    return got.select("path", "part_index", "part_name", F.col("content").cast("string").alias("content"))


@query("""select cast(n_nationkey as varchar) as path, part_index, case part_index when 0 then 'T' when 1 then 'T (2)' else 'a_b' end as stem from nation cross join (values (0), (1), (2)) p(part_index)""")
def part_file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a file's parts: made safe, numbered where they clash."""
    n = table(spark, sf_dir, "nation")
    one = "| c |\n| --- |\n| 1 |\n\n"
    content = F.concat(F.lit(f"# T\n\n{one}# t\n\n{one}".replace("# t", "# T") + f"# a/b\n\n{one}"), "n_name")
    return batch.with_stems(convert(_files(n, n.n_nationkey, content), "markdown", "csv")).select("path", "part_index", "stem")


@query("select cast(c_custkey as varchar) as path, 'a,b' || chr(10) || c_custkey || ',\"x,y\"' || chr(10) as content from customer")
def delimited_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolons are found; a given delimiter is written and read."""
    c = table(spark, sf_dir, "customer")
    there = convert(_files(c, c.c_custkey, F.concat(F.lit("a;b\n"), "c_custkey", F.lit(";x,y\n"))), "csv", "tsv")
    return convert(there.select("path", "content"), "tsv", "csv").select("path", F.col("content").cast("string").alias("content"))


@query("select cast(n_nationkey as varchar) as path, sheet, 'v' || chr(10) || case sheet when 'second' then n_name else 'S' || n_nationkey end || chr(10) as content from nation cross join (values ('1'), ('second')) s(sheet)")
def sheet_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet by number or by name."""
    n, out = table(spark, sf_dir, "nation"), None
    content = F.concat(F.lit('{"first":[{"v":"S'), "n_nationkey", F.lit('"}],"second":[{"v":"'), "n_name", F.lit('"}]}'))
    books = convert(_files(n, n.n_nationkey, content), "json", "xlsx").select("path", "content")
    for sheet in ("1", "second"):
        got = convert(books, "xlsx", "csv", sheet=sheet).select("path", F.lit(sheet).alias("sheet"), F.col("content").cast("string").alias("content"))
        out = got if out is None else out.unionByName(got)
    return out


@query("select cast(n_regionkey as varchar) as region, cast(count(*) as int) as pages, cast(null as varchar) as error from nation group by all")
def merged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as pages of one PDF: as many pages as pictures."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), "n_regionkey")
    pictures = _pictures(spark, sf_dir, "flat").join(n, "path").withColumn("path", F.concat("path", F.lit(".pgm")))
    return batch.merge_images(pictures, "n_regionkey", "path").select(F.col("group").alias("region"), "pages", "error")


# names, planner, functions

@query("select p_partkey, 'out/' || p_partkey || '.v1.yaml' as output from part")
def batch_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", batch.output_path(F.concat(F.lit("/"), "p_partkey", F.lit(".v1.json")), "yaml", "out/").alias("output"))


@query("select cast(n_regionkey as varchar) || '.json' as output, count(*) as n from nation group by all having count(*) > 1")
def batch_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return batch.clashes(n.select(F.concat("n_regionkey", F.lit("."), F.element_at(F.array(F.lit("csv"), F.lit("tsv")), (F.col("n_nationkey") % 2 + 1).cast("int"))).alias("path")), "json")


@query(f"select id, id as found from (values {_values([(f['id'],) for f in catalogue.formats()])}) f(id)")
def find_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.plans import detection

    return catalogue.formats_table(spark).select("id", detection.by_id(F.upper("id")).alias("found"))


@query(f"select source, target, fidelity, count(*) as n from (values {_values(catalogue.edges())}) e(name, source, target, fidelity) group by all")
def listed_converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.edges_table(spark).groupBy("source", "target", "fidelity").agg(F.count(F.lit(1)).alias("n"))


@query(f"select id, 'refused' as answer from (values {_values([(f['id'],) for f in catalogue.formats()])}) f(id)")
def same_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A format to itself is no conversion."""

    def answer(i: str) -> str:
        try:
            return planner.plan(i, i).worst
        except ValueError:
            return "refused"

    return spark.createDataFrame([(f["id"], answer(f["id"])) for f in catalogue.formats()], "id string, answer string")


@query("select page_id, url_decode(replace(url, ' ', '%20') || '%C3%A9%2F%20%41') as decoded from pages")
def percent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.function("percent_decode")(F.concat(F.replace("url", F.lit(" "), F.lit("%20")), F.lit("%C3%A9%2F%20%41"))).alias("decoded"))


@query("select page_id, url || ' & < > \" é é ™ &unknown; &amp' as decoded from pages")
def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.function("entity_decode")(F.concat("url", F.lit(" &amp; &lt; &#62; &quot; &eacute; &#xE9; &trade; &unknown; &amp"))).alias("decoded"))


@query("select l_orderkey, l_linenumber, cast(cast(l_extendedprice as double) as varchar) as shown from lineitem")
def float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.function("float_text")(F.col("l_extendedprice").cast("double")).alias("shown"))


@query("select event_id, case event_id % 4 when 0 then ',' when 1 then ';' when 2 then chr(9) else '|' end as delimiter from events")
def sniff_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("a"), d, F.lit("b"), d, F.lit("c\n"), "event_type", d, F.lit('"x,;|y"'), d, F.lit("1\n"))
    return e.select("event_id", S.function("sniff_delimiter")(text).alias("delimiter"))


@query("""select event_id, '{"a":{"b":[1,2.5,null,true],"c":"' || event_type || '"}}' as compact from events""")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    yaml = F.concat(F.lit("a:\n  b: [1, 2.5, ~, true]\n  c: "), "event_type", F.lit("\n"))
    return e.select("event_id", S.function("yaml_to_json")(yaml).alias("compact"))


def _sql_replaced(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, {a}, '{b}')"
    return column


_QUOTED = _sql_replaced("text || chr(1) || chr(127) || chr(9)", [("chr(92)", "\\\\"), ("chr(34)", '\\"'), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t"), ("chr(1)", "\\u0001"), ("chr(127)", "\\u007F")])


@query(f"select conv_id, turn, '\"' || {_QUOTED} || '\"' as literal from conversations")
def double_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.double_quoted(F.concat("text", F.lit("\x01\x7f\t"))).alias("literal"))


@query("select p_partkey, case when p_size between 1 and 9 then p_size else 0 end as level from part")
def heading_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    style = F.concat(F.element_at(F.array(F.lit("Heading "), F.lit(" heading"), F.lit("HEADING  ")), (F.col("p_partkey") % 3 + 1).cast("int")), "p_size")
    return p.select("p_partkey", F.coalesce(T.heading_number(style).cast("long"), F.lit(0)).alias("level"))


@query("select o_orderkey, date_diff('day', date '1899-12-30', cast(o_orderdate as date)) + (o_orderkey % 24 * 3600.0 + 90) / 86400.0 as serial from orders")
def date_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":01:30.0Z"))
    return o.select("o_orderkey", T.date_serial(text).alias("serial"))


@query("""select event_id, case when event_id % 5 = 0 then null else (case when event_id % 2 = 0 then -1 else 1 end) * ((event_id % 3) * 86400.0 + (event_id % 30) * 3600.0 + 30) / 86400.0 end as days from events""")
def duration_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    text = F.concat(F.when(i % 2 == 0, "-").otherwise(""), F.lit("P"), F.when(i % 5 == 0, "1Y").otherwise(""), i % 3, F.lit("DT"), i % 30, F.lit("H0M30.0S"))
    return e.select("event_id", T.duration_days(text).alias("days"))


@query("select event_id, lpad(cast(event_id % 90 as varchar), 2, '0') || ':' || lpad(cast(event_id % 60 as varchar), 2, '0') || ':05' as shown from events")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", T.duration_text(((i % 90) * 3600 + (i % 60) * 60 + 5) / F.lit(86400.0)).alias("shown"))


@query("select p_partkey, p_partkey % 4 = 0 as joins from part")
def hyphen_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", T.hyphen_break(pick("wor-", "wor-", "1-", "wor"), pick("ken", "Ken", "ken", "ken")).alias("joins"))


@query("select p_partkey, p_partkey % 4 < 2 as cjk from part")
def cjk_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.element_at(F.array(*map(F.lit, ("日本語 ＡＢ", "カナ、𠮷", "日本 a", "  "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", T.is_cjk(text).alias("cjk"))


@query(f"select p_partkey, 'x' || good as unified from part join (values {_values([(k, b) for k, b in enumerate(T.radicals().values())])}) r(k, good) on p_partkey % {len(T.radicals())} = k")
def unified_radicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, known = table(spark, sf_dir, "part"), list(T.radicals())
    text = F.concat(F.lit("x"), F.element_at(F.array(*map(F.lit, known)), (F.col("p_partkey") % len(known) + 1).cast("int")))
    return p.select("p_partkey", T.unify_radicals(text).alias("unified"))


@query("select page_id, replace(replace(url, '&', '&amp;'), '''', '&#x27;') || '%20%C3%A9%22&amp;' as escaped from pages")
def href_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.function("href_escape")(F.concat("url", F.lit(' é"&'))).alias("escaped"))


@query(f"select name, fidelity <> 'lossless' as told from (values {_values(catalogue.edges())}) e(name, source, target, fidelity)")
def loss_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e[0], planner.Plan((e,)).loss_descriptions) for e in catalogue.edges()]
    return spark.createDataFrame(rows, "name string, said array<string>").select("name", (F.size("said") == 1).alias("told"))


@query("""select cast(c_custkey as varchar) as path, 0 as number, case c_custkey % 2 when 0 then '{"event":"done","path":"' || c_custkey || '","parts":1,"bytes":' || length('a: ' || c_custkey || chr(10)) || '}'
          else '{"event":"error","path":"' || c_custkey || '","kind":"malformed","message":"Expecting value"}' end as line from customer""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    content = F.concat(F.lit('{"a":'), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(""), F.lit("}"))
    return batch.events(convert(_files(c, c.c_custkey, content), "json", "yaml")).select("path", "number", "line")


@query("select case when n_nationkey % 5 = 0 then 'in/' || n_nationkey || '.txt' else 'in/r' || n_regionkey || '.pages' end as path, count(*) as members from nation group by all")
def package_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a package folder become one archive."""
    n = table(spark, sf_dir, "nation")
    path = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("in/"), "n_nationkey", F.lit(".txt"))).otherwise(F.concat(F.lit("in/r"), "n_regionkey", F.lit(".pages/Index/"), "n_nationkey", F.lit(".iwa")))
    packed = batch.package_folders(n.select(path.alias("path"), F.col("n_name").cast("binary").alias("content")))
    # a member has one entry in the archive's directory
    count = F.when(F.col("path").endswith(".pages"), (F.length(F.hex("content")) - F.length(F.replace(F.hex("content"), F.lit("504B0102"), F.lit("")))) / 8).otherwise(1)
    return packed.select("path", count.cast("long").alias("members"))


NOTES = [("markdown", t) for t in ("docx", "odt", "rtf")] + [(s, "markdown") for s in ("docx", "odt", "rtf")]


@query(_expected(NOTES, "select cast(s_suppkey as varchar) as path, s_name || '[^1] and *more*[^2].' || chr(10) || chr(10) || '[^1]: Nation ' || s_nationkey || chr(10) || chr(10) || '    Second.' || chr(10) || chr(10) || '[^2]: **Last**' || chr(10) as content from supplier"))
def note_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes stay footnotes."""
    p = table(spark, sf_dir, "supplier")
    content = F.concat("s_name", F.lit("[^a] and *more*[^b].\n\n[^a]: Nation "), "s_nationkey", F.lit("\n\n    Second.\n\n[^b]: **Last**\n"))
    out = None
    for s, t in NOTES:
        kind = t if s == "markdown" else s
        got = convert_along(_files(p, p.s_suppkey, content), [("markdown", kind), (kind, "markdown")])
        got = got.select(F.lit(f"{s} {t}").alias("edge"), "path", F.replace("content", F.lit("\\#"), F.lit("#")).cast("string").alias("content"), F.col("error.message").alias("error"))
        out = got if out is None else out.unionByName(got)
    return out


def _roman(n: int) -> str:
    out = ""
    for value, letters in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + letters * (n // value), n % value
    return out


@query(f"select o_orderkey, roman, lpad('', cast((o_orderkey % 400) // 26 + 1 as int), chr(cast(97 + o_orderkey % 400 % 26 as int))) as letter from orders join (values {_values([(k, _roman(k + 1)) for k in range(400)])}) r(k, roman) on o_orderkey % 400 = k")
def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 400 + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", T.list_number(n, "upperRoman").alias("roman"), T.list_number(n, "lowerLetter").alias("letter"))


_LINES = "l_orderkey || ',' || l_linenumber || ',' || l_partkey || ',' || l_suppkey || ',' || l_returnflag || ',' || l_linestatus"
_LINE_NAMES = ("order", "line", "part", "supplier", "returned", "status")


def _lineitem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of the lines of 2,000 orders each."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.select((F.col("l_orderkey") / 2000).cast("long").cast("string").alias("path"), "l_orderkey", "l_linenumber", F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("line"))
    files = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line"))).alias("l"))
    return files.select("path", F.concat(F.lit(",".join(_LINE_NAMES) + "\n"), F.array_join("l.line", "\n"), F.lit("\n")).cast("binary").alias("content"))


@query(
    """select cast(l_orderkey // 2000 as varchar) as path, count(*) as n_lines, sha256(string_agg('{"order":"' || l_orderkey || '","line":"' || l_linenumber || '","part":"' || l_partkey || '","supplier":"' || l_suppkey || '","returned":"' || l_returnflag
    || '","status":"' || l_linestatus || '"}' || chr(10), '' order by l_orderkey, l_linenumber, l_orderkey || ',' || l_linenumber || ',' || l_partkey || ',' || l_suppkey || ',' || l_returnflag || ',' || l_linestatus)) as digest from lineitem group by all"""
)
def lineitem_csv_to_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = convert(_lineitem_files(spark, sf_dir), "csv", "jsonl")
    return got.select("path", (F.size(F.split(F.col("content").cast("string"), "\n")) - 1).cast("long").alias("n_lines"), F.sha2("content", 256).alias("digest"))
