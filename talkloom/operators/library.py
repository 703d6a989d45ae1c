"""The meeting library: storing, listing and searching.

Search goes to a table of postings (term, id, field, positions), bucketed by term,
so that a query reads the buckets of its own terms and not the texts, and to a table
of lengths (id, len).
"""

from __future__ import annotations

import json
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.operators.rows import in_order
from talkloom.streaming.runs import file_system, stored

COLUMNS = "id long, ts string, title string, date date, summary_md string, transcript_md string, save_dir string, duration int, created_at timestamp"
FIELDS = ("title", "summary_md", "transcript_md")
K1, B = 1.2, 0.75
#: Buckets of the postings, by term.
BUCKETS = 64


def meeting_date(ts: Column, today: Column) -> Column:
    """Date of a yyyyMMdd_HHmmss stamp; today where it is none."""
    return F.coalesce(F.to_date(F.try_to_timestamp(ts, F.lit("yyyyMMdd_HHmmss"))), today)


def create_library(spark: SparkSession, name: str = "meetings") -> None:
    """Makes the meetings and postings tables unless they exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_postings (id long, field string, term string, positions array<int>, n_tokens int) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {BUCKETS} BUCKETS")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_lengths (id long, len long) USING parquet")


def add_meetings(new: DataFrame, name: str = "meetings", now: Column | None = None) -> DataFrame:
    """Appends meetings (title, summary_md, transcript_md, save_dir, duration, ts),
    their postings and lengths; ids go on from the greatest, in order of (ts, title).
    Returns the rows with ids. Where the postings cannot be written, the meetings
    stay: search falls back to their texts, and rebuild_index() mends it."""
    spark, now = new.sparkSession, F.current_timestamp() if now is None else now
    last = spark.table(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = in_order(new, "_nth", "ts", "title")
    rows = numbered.select((F.col("_nth") + F.lit(last)).alias("id"), "ts", "title", meeting_date(F.col("ts"), F.to_date(now)).alias("date"), "summary_md", "transcript_md", "save_dir", F.coalesce(F.col("duration").cast("int"), F.lit(0)).alias("duration"), F.date_trunc("second", now).alias("created_at"))
    rows.write.insertInto(name)
    added = spark.table(name).where(F.col("id") > last)
    try:
        _index(added, name)
    except Exception as e:  # noqa: BLE001  whatever the index's storage raises, meetings are kept
        warnings.warn(f"meetings are stored, their index is not: {e}", stacklevel=2)
    return added


def _index(meetings: DataFrame, name: str) -> None:
    postings(meetings).write.insertInto(f"{name}_postings")
    lengths(meetings).write.insertInto(f"{name}_lengths")


def rebuild_index(spark: SparkSession, name: str = "meetings") -> None:
    """Indexes stored meetings that have no length yet."""
    missing = spark.table(name).join(spark.table(f"{name}_lengths"), "id", "left_anti")
    known = spark.table(f"{name}_postings").select("id", "field", "term")
    postings(missing).join(known, ["id", "field", "term"], "left_anti").write.insertInto(f"{name}_postings")
    lengths(missing).write.insertInto(f"{name}_lengths")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without diacritics of Latin letters."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(folded, F.lit(r"(?U)[\p{L}\p{N}\p{M}\p{Co}]+"), 0)


def postings(meetings: DataFrame) -> DataFrame:
    """id, field, term, positions and the field's number of tokens. A field's tokens
    stand in one row: sorted there by term and place, runs of a term are its positions,
    and nothing is shuffled."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("t")) for f in FIELDS])
    each = meetings.select("id", F.explode(fields).alias("f")).select("id", "f.field", F.transform("f.t", lambda t, at: F.struct(t.alias("term"), at.alias("at"))).alias("t")).where(F.size("t") > 0)
    ordered = each.select("id", "field", F.sort_array("t").alias("t")).select("id", "field", F.col("t.term").alias("terms"), F.col("t.at").alias("places"), F.size("t").alias("n_tokens"))
    starts = F.filter(F.sequence(F.lit(1), F.col("n_tokens")), lambda k: (k == 1) | (F.get("terms", k - 1) != F.get("terms", k - 2)))
    runs = ordered.withColumn("starts", starts).withColumn("stops", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.col("n_tokens") + 1)))
    out = runs.select("id", "field", "terms", "places", "n_tokens", F.explode(F.arrays_zip("starts", "stops")).alias("r"))
    return out.select("id", "field", F.get("terms", F.col("r.starts") - 1).alias("term"), F.slice("places", F.col("r.starts"), F.col("r.stops") - F.col("r.starts")).alias("positions"), "n_tokens")


def recent(meetings: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first; a negative limit is none."""
    ordered = meetings.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered if limit < 0 else ordered.limit(limit)


def get(meetings: DataFrame, meeting_id: int) -> DataFrame:
    return meetings.where(F.col("id") == F.lit(int(meeting_id)))


def contains(meetings: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Meetings with the query in a field, newest first: ASCII letters match in
    either case; % and _ stand for any text and any character."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = lambda c: F.translate(c, upper, lower)
    pattern = "".join(".*" if c == "%" else "." if c == "_" else f"\\x{{{ord(c):x}}}" for c in query.translate(str.maketrans(upper, lower)))
    hit = lambda f: F.regexp_like(fold(F.coalesce(F.col(f), F.lit(""))), F.lit(f"(?s){pattern}"))
    return recent(meetings.where(hit(FIELDS[0]) | hit(FIELDS[1]) | hit(FIELDS[2])), limit)


def lengths(meetings: DataFrame) -> DataFrame:
    """id and len, the number of tokens of all fields."""
    return meetings.select("id", sum((F.size(tokens(F.col(f))) for f in FIELDS), F.lit(0)).cast("long").alias("len"))


def ranked(meetings: DataFrame, index: DataFrame, query: str, limit: int = 50, sizes: DataFrame | None = None) -> DataFrame:
    """Meetings that hold every phrase of the query (its blank-separated words, each
    tokenised), with `score`, bm25 over all fields (smaller is better), best first.
    Of the index only the query's terms are read; sizes is what lengths() gave."""
    spark = meetings.sparkSession
    given = spark.createDataFrame([(k, w) for k, w in enumerate(T.phrases_of(query))], "phrase int, word string").select("phrase", F.posexplode(tokens(F.col("word"))).alias("nth", "term"))
    words = [tuple(r) for r in given.collect()]  # the query's own words
    parsed = spark.createDataFrame(words, "phrase int, nth int, term string")
    wanted = F.broadcast(parsed.withColumn("parts", F.count("*").over(Window.partitionBy("phrase"))))
    shifted = index.where(F.col("term").isin([w for *_, w in words])).join(wanted, "term").withColumn("starts", F.transform("positions", lambda p: p - F.col("nth")))
    # a phrase starts where each of its words, moved back by its place, stands
    starts = shifted.select("id", "field", "phrase", "parts", F.explode("starts").alias("start")).groupBy("id", "field", "phrase", "parts", "start").agg(F.count("*").alias("n")).where("n = parts")
    hits = starts.groupBy("id", "phrase").agg(F.count("*").alias("tf"))
    phrases = len({k for k, *_ in words})
    frequency = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    sizes = lengths(meetings) if sizes is None else sizes
    scale = sizes.agg(F.count("*").alias("docs"), F.sum("len").alias("words")).withColumn("mean", F.col("words") / F.col("docs"))  # one row
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = hits.join(F.broadcast(frequency), "phrase").join(sizes, "id").crossJoin(F.broadcast(scale)).groupBy("id").agg((-F.sum(part)).alias("score"), F.count("*").alias("found"))
    best = scored.where(F.col("found") == phrases).drop("found")
    out = meetings.join(best, "id").orderBy("score", "id")
    return out if limit < 0 else out.limit(limit)


def search(meetings: DataFrame, index: DataFrame, query: str, limit: int = 50, sizes: DataFrame | None = None, ranked_limit: int | None = None) -> DataFrame:
    """Blank query: recent meetings. Else ranked ones; where there are none, those
    that contain the query as text. ranked_limit: of ranked ones, if another than
    limit; a negative one is none."""
    query = (query or "").strip()
    if not query:
        return recent(meetings, limit)
    # ranked once: what is found is laid down, then looked at and joined
    most = limit if ranked_limit is None else ranked_limit
    best = stored(ranked(meetings.select("id"), index, query, most, lengths(meetings) if sizes is None else sizes), "found")
    return contains(meetings, query, limit) if best.isEmpty() else meetings.join(best, "id").orderBy("score", "id").drop("score")


# --- a library of files, published whole ----------------------------------------------

#: Its tables, each a folder of Parquet files by version.
TABLES = ("meetings", "postings", "lengths")


def publish(new: DataFrame, path: str, now: Column | None = None) -> int:
    """Adds meetings (title, summary_md, transcript_md, save_dir, duration, ts) to the
    library at a path: rows, postings and lengths are written aside, then one manifest
    publishes them together. Returns the version's number.

    A reader sees all three tables of a version or none: what a failed call has written
    is named by no manifest. Manifests are numbered, and made only where there is none of
    that number, so of two writers at once one goes first and the other follows it. Ids
    go on from the greatest, in order of (ts, title): rows hold their place in the
    version, and the manifest what comes before."""
    spark, now = new.sparkSession, F.current_timestamp() if now is None else now
    version = uuid.uuid4().hex
    numbered = in_order(new, "id", "ts", "title")
    rows = numbered.select(F.col("id").cast("long").alias("id"), "ts", "title", meeting_date(F.col("ts"), F.to_date(now)).alias("date"), "summary_md", "transcript_md", "save_dir", F.coalesce(F.col("duration").cast("int"), F.lit(0)).alias("duration"), F.date_trunc("second", now).alias("created_at"))
    rows.write.parquet(f"{path}/meetings/version={version}")
    written = spark.read.parquet(f"{path}/meetings/version={version}")
    terms = postings(written).repartition("term").sortWithinPartitions("term")  # so that a term's files and row groups are few
    terms.write.parquet(f"{path}/postings/version={version}")
    lengths(written).write.parquet(f"{path}/lengths/version={version}")
    return _announce(spark, path, version, written.count())


def _announce(spark: SparkSession, path: str, version: str, rows: int) -> int:
    while True:
        number, known = _newest(spark, path)
        before = sum(v["rows"] for v in known)
        listed = [*known, {"version": version, "rows": rows, "before": before}]
        fs, place = file_system(spark, f"{path}/manifests/{number + 1:010d}.json")
        try:
            out = fs.create(place, False)
        except Py4JJavaError as e:
            if fs.exists(place):
                continue  # another writer was first
            raise e
        try:
            out.write(bytearray(json.dumps(listed).encode()))
        finally:
            out.close()
        return number + 1


def _newest(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """The greatest number of a manifest, and what the newest whole one lists."""
    fs, place = file_system(spark, f"{path}/manifests")
    if not fs.exists(place):
        return 0, []
    names = sorted((str(s.getPath().getName()) for s in fs.listStatus(place) if str(s.getPath().getName()).endswith(".json")), reverse=True)
    for name in names:
        data = fs.open(file_system(spark, f"{path}/manifests/{name}")[1])
        try:
            text = bytes(data.readAllBytes()).decode()
        finally:
            data.close()
        try:
            return int(names[0].split(".")[0]), json.loads(text)
        except json.JSONDecodeError:
            continue  # its writer stopped within it
    return int(names[0].split(".")[0]) if names else 0, []


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """meetings, postings and lengths of the library at a path, all of the newest whole
    version; later ones do not change what this has returned."""
    schemas = {"meetings": COLUMNS, "postings": "id long, field string, term string, positions array<int>, n_tokens int", "lengths": "id long, len long"}
    _, known = _newest(spark, path)
    if not known:
        return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    before = F.create_map(*[x for v in known for x in (F.lit(v["version"]), F.lit(v["before"]))])
    out = {}
    for name in TABLES:
        # versions are partitions: those that no manifest names are not read
        rows = spark.read.option("basePath", f"{path}/{name}").schema(f"{schemas[name]}, version string").parquet(*[f"{path}/{name}/version={v['version']}" for v in known])
        out[name] = rows.withColumn("id", F.col("id") + F.element_at(before, F.col("version"))).drop("version")
    return out
