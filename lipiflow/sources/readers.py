"""Readers of the engine's input formats. Schemas are explicit; bad rows are counted, not lost silently."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import HEADER_PATTERNS, is_latin_only, has_bengali, is_safe_component

SOURCE_BITS = {"dakshina": 1, "aksharantar": 2, "banglatlit": 4}  # fixed values
EVENTS = "h string, roman string, chose string, we_said string, pos long, retyped boolean"
METRICS_CORE = ("words", "top1_taken", "retyped", "next_shown", "next_taken", "predicted_taken", "lat_n")
TUNE_CACHE = "set string, roman string, golds array<string>, weight double, cands array<struct<word string, uni double, rom_exact int, rom_prefix int, key_fine boolean, key_coarse boolean, key_fine_prefix boolean, key_coarse_prefix boolean, gap int, xlit_rank int, xlit_logp double, avro boolean, in_lexicon boolean, bigram double, spelled boolean>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """The tuner's cache: q, set, roman, golds, weight and a candidate's word and features, a row for each candidate.

    q is a hash of what makes an item. An item without candidates has no rows here; its absence counts against no weights.
    """
    rows = spark.read.schema(TUNE_CACHE).json(path).withColumn("q", F.xxhash64("set", "roman", F.array_join("golds", "|")))
    return rows.select("q", "set", "roman", "golds", "weight", F.inline("cands"))


def lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """line of a plain or gzip text file; a gzip file is one task's until it is dealt out."""
    df = spark.read.text(path).withColumnRenamed("value", "line")
    return df.repartition(partitions) if partitions else df


def attestations(spark: SparkSession, path: str) -> DataFrame:
    """word, roman, count, bad of `native TAB roman TAB count`; short rows are left out, a bad count is 1 and bad."""
    parts = F.split("line", "\t")
    rows = lines(spark, path).where(F.size(parts) >= 3)
    count = F.expr("try_cast(split(line, '\t')[2] AS double)")
    return rows.select(parts[0].alias("word"), parts[1].alias("roman"), F.coalesce(count, F.lit(1.0)).alias("count"), count.isNull().alias("bad"))


def mined_pairs(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """word, roman, source, bad of JSON lines; bad rows have NULL words."""
    schema = "`native word` string, `english word` string, source string, score double, _bad string"
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    out = df.select(F.col("native word").alias("word"), F.col("english word").alias("roman"), "source", (F.col("_bad").isNotNull() | F.col("native word").isNull() | F.col("english word").isNull()).alias("bad"))
    return out.where(F.col("source").isin(*sources) | F.col("bad")) if sources else out


def chat_sentences(spark: SparkSession, path: str) -> DataFrame:
    """id, text_bengali, text_transliterated of a CSV file with a header and quoted line breaks."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select("id", "text_bengali", "text_transliterated")


def train_rows(spark: SparkSession, train: str, held: list[str]) -> DataFrame:
    """Rows of train whose id or Bengali text is neither an id nor a text of the held-out files."""
    rows = chat_sentences(spark, train)
    for path in held:
        other = chat_sentences(spark, path)
        marks = other.select(F.col("id").alias("_m")).union(other.select("text_bengali")).distinct()
        rows = rows.join(marks, rows.id == marks._m, "left_anti").join(marks, rows.text_bengali == marks._m, "left_anti")
    return rows


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """word, count of lines with exactly a word and an integer."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).select(parts.alias("p")).where(F.size("p") == 2)
    return rows.select(F.col("p")[0].alias("word"), F.expr("try_cast(p[1] AS bigint)").alias("count")).where("count IS NOT NULL")


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """roman, gold, tags: a row for each gold, which may be a string or an array; lines that begin with # are comments."""
    raw = lines(spark, path).where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    many = F.from_json("line", "roman string, gold array<string>, tags array<string>")
    one = F.from_json("line", "roman string, gold string, tags array<string>")
    text = F.get_json_object("line", "$.gold")
    golds = F.when(text.startswith("["), many["gold"]).otherwise(F.array(one["gold"]))
    return raw.select(one["roman"].alias("roman"), F.explode(golds).alias("gold"), one["tags"].alias("tags")).where("roman IS NOT NULL AND gold IS NOT NULL")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of valid JSON objects; blank and torn lines are skipped."""
    parsed = lines(spark, path).select(F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "line")
    return parsed.where(F.col("line").rlike(r"^\s*\{.*\}\s*$") & F.col("r").isNotNull()).select("r.*")


def rule_bundle(spark: SparkSession, path: str) -> dict:
    """A rule bundle, one JSON object, for operators.rules; it is small and travels with the tasks."""
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def chunks(spark: SparkSession, root: str, stream: str, ordered: bool = False) -> DataFrame:
    """line, install, stream, seq, chunk of <root>/<install>/<stream>-<seq>.jsonl; unsafe names are left out.

    ordered: by install and then the file's name, as a scan of the folders would meet them.
    """
    df = spark.read.text(f"{root}/*/{stream}-*.jsonl").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"))
    pattern = r"([^/]+)/((metrics|events)-(\d+)\.jsonl)$"
    part = lambda i: F.regexp_extract("_path", pattern, i)
    out = df.select("line", part(1).alias("install"), part(3).alias("stream"), part(4).cast("bigint").alias("seq"), part(2).alias("chunk"))
    out = out.where((F.trim("line") != "") & is_safe_component("install"))
    return out.orderBy("install", "chunk") if ordered else out


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """install, h, the core counters (absent ones 0), lat_p50, lat_p95 and counters, a map of all other whole numbers."""
    raw = chunks(spark, root, "metrics").withColumn("m", F.from_json("line", "map<string,string>")).where("m IS NOT NULL")
    number = lambda k: F.expr(f"try_cast(try_element_at(m, '{k}') AS bigint)")
    rest = F.map_filter(F.transform_values("m", lambda k, v: v.try_cast("bigint")), lambda k, v: v.isNotNull() & ~k.isin(*METRICS_CORE, "h", "id"))
    return raw.select("install", F.try_element_at("m", F.lit("h")).alias("h"), *(F.coalesce(number(k), F.lit(0)).alias(k) for k in METRICS_CORE), *(F.expr(f"try_cast(try_element_at(m, '{k}') AS double)").alias(k) for k in ("lat_p50", "lat_p95")), rest.alias("counters"))


def valid_headers(df: DataFrame) -> DataFrame:
    """Rows whose install, stream and seq have the permitted forms."""
    for name, pattern in HEADER_PATTERNS.items():
        df = df.where(F.col(name).cast("string").rlike(pattern))
    return df


def aligned_pairs(df: DataFrame, bangla: str, roman: str) -> DataFrame:
    """word, roman, pos of parallel token arrays of equal size; the pair must be Bengali and Latin."""
    rows = df.where(F.size(bangla) == F.size(roman)).select("*", F.posexplode(F.arrays_zip(F.col(bangla).alias("b"), F.col(roman).alias("r"))).alias("pos", "_z"))
    out = rows.select(*(c for c in df.columns if c not in (bangla, roman)), F.col("_z.b").alias("word"), F.col("_z.r").alias("roman"), "pos")
    return out.where(is_latin_only("roman") & has_bengali("word") & ~F.col("word").rlike("[A-Za-z]"))


def half_split(df: DataFrame, order: str, first: bool) -> DataFrame:
    """The first or the second half by `order`, for a file that holds both splits."""
    from ..operators.evaluate import ordinals

    n = df.count()
    rows = ordinals(df, order)
    return rows.where((F.col("_ordinal") < n // 2) if first else (F.col("_ordinal") >= n // 2)).drop("_ordinal")


def block_list(text: str) -> tuple[list[str], list[str]]:
    """exact words (lines that begin with =) and roots of a list; # begins a comment."""
    rows = [r for line in text.splitlines() if (r := line.split("#")[0].strip())]
    return [r[1:].strip() for r in rows if r.startswith("=")], [r for r in rows if not r.startswith("=")]


def requests(df: DataFrame) -> DataFrame:
    """op and fields of raw JSON requests (value); op is `suggest` where it is absent."""
    parsed = F.from_json("value", "op string, roman string, context array<string>, k int, chosen string, index int, session string")
    return df.select(parsed.alias("r")).where("r IS NOT NULL").select(F.coalesce("r.op", F.lit("suggest")).alias("op"), *(f"r.{c}" for c in ("roman", "context", "k", "chosen", "index", "session")))


def overlaid(*configs: dict) -> dict:
    """Configurations key by key, the later over the earlier."""
    out: dict = {}
    for c in configs:
        out |= {k: v for k, v in c.items() if v is not None}
    return out


DATASETS: dict = {}


def dataset(name: str):
    """Registers a loader under `name`; resolve() parses name[:source,source][+grouped]."""

    def keep(f):
        DATASETS[name] = f
        return f

    return keep


def resolve(spark: SparkSession, spec: str) -> DataFrame:
    from ..operators.evaluate import grouped_wordset

    spec, _, flag = spec.partition("+")
    name, _, sources = spec.partition(":")
    if name not in DATASETS:
        raise KeyError(f"no dataset named {name!r}; there are {sorted(DATASETS)}")
    rows = DATASETS[name](spark)
    rows = rows.where(F.col("source").isin(*sources.split(","))) if sources else rows
    return grouped_wordset(rows) if flag == "grouped" else rows
