"""A catalogue of papers from the folders that hold their files: metadata.json, deep_read.json (the report) and chunk.json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import identity

#: Names of a paper's files, the source of a report on the full text, and the version of stored chunks (fixed values).
FILES = {"metadata": "metadata.json", "report": "deep_read.json", "chunks": "chunk.json"}
FULL_TEXT, VERSION = "fulltext", 10


def files(spark: SparkSession, root: str) -> DataFrame:
    """place (the folder's path), file, payload of the files above, at any depth below `root`; other files aren't opened."""
    names = "{" + ",".join(FILES.values()) + "}"
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    path = F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return raw.select(F.regexp_replace(path, "/[^/]*$", "").alias("place"), F.regexp_extract(path, "([^/]*)$", 1).alias("file"), F.col("value").alias("payload"))


def papers(found: DataFrame, version: int = VERSION, most: int = 4000) -> DataFrame:
    """The rows of `catalogue`, save that a paper's further places are ok too.

    Each file is read where it lies; only what it says comes together by place, not its text."""
    get = lambda v, path: F.coalesce(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>"), F.lit(False))
    of = lambda kind, says: F.first(F.when((F.col("file") == FILES[kind]) & F.col("there"), says), True).alias(kind)
    m, r = F.try_parse_json(F.when(F.col("file") == FILES["metadata"], F.col("payload"))), F.try_parse_json(F.when(F.col("file") == FILES["report"], F.col("payload")))
    text = lambda k: F.length(F.coalesce(k["content"], F.lit("")))
    c = F.from_json(F.when(F.col("file") == FILES["chunks"], F.col("payload")), "version bigint, chunks array<struct<content:string>>")
    usable = F.coalesce((F.col("c.version") == version) & (F.size("c.chunks") > 0) & F.forall("c.chunks", lambda k: text(k).between(1, most)), F.lit(False))
    report = F.when(~is_object(F.col("r")), "broken_report").when(~F.coalesce(F.try_variant_get("r", "$.source", "string") == FULL_TEXT, F.lit(False)), "not_full_text").otherwise("")
    part = lambda name, bare: F.when(F.col("whole"), get("m", f"$.paper.{name}")).otherwise(get("m", "$.paperId") if bare else F.lit("")).alias(name)
    metadata = F.struct("whole", part("paperId", True), part("id", True), part("doi", False), part("title", True), part("year", False))
    read = found.select("place", "file", F.col("payload").isNotNull().alias("there"), m.alias("m"), r.alias("r"), c.alias("c")).withColumn("whole", is_object(F.try_variant_get("m", "$.paper", "variant")))
    facts = read.select("place", "file", "there", metadata.alias("m"), report.alias("r"), usable.alias("c"))
    each = facts.groupBy("place").agg(of("metadata", F.col("m")), of("report", F.col("r")), of("chunks", F.col("c")))
    said = lambda name: F.coalesce(f"metadata.{name}", F.lit(""))
    whole = F.coalesce("metadata.whole", F.lit(False))
    known = each.withColumns({"folder": F.regexp_extract("place", "([^/]*)$", 1), "id": said("paperId"), "other_id": said("id"), "doi": said("doi"), "title": said("title"), "year": identity.year(said("year"))})
    status = F.when(F.col("report").isNull(), "no_report").when(F.col("report") != "", F.col("report")).when(~F.coalesce("chunks", F.lit(False)), "no_usable_chunks").when(~whole & (F.col("id") == ""), "no_metadata").otherwise("ok")
    ids = [F.col("id"), F.col("other_id")]
    aliases = F.array_sort(F.array_distinct(F.concat(identity.aliases(ids, F.col("doi"), F.col("title")), F.array("folder"))))
    return known.select("place", "folder", status.alias("status"), identity.paper_key(ids, F.col("doi"), F.col("title"), F.col("folder")).alias("key"), "title", "year", aliases.alias("aliases"), F.col("chunks").isNotNull().alias("has_file"))


def catalogue(found: DataFrame, version: int = VERSION, most: int = 4000) -> DataFrame:
    """A row for each place: folder (its name), status, key, title, year, aliases (sorted, the folder's name among them), has_file (whether there is a chunk file).

    status is the first that holds of no_report, broken_report, not_full_text, no_usable_chunks (no file, a broken one, another version, no chunk, or one
    without text or longer than `most`), no_metadata (none, broken, or without a paper), duplicate (a lesser place has the paper), ok. Only places that are ok belong to the
    catalogue; the others say why not. Broken metadata leaves the folder's name as key."""
    each = papers(found, version, most)
    ok = F.col("status") == "ok"
    first = each.where(ok).groupBy(F.col("key").alias("_key")).agg(F.min("place").alias("_first"))  # a window over a key would hold all of its places
    kept = each.join(first, ok & (F.col("key") == F.col("_key")), "left")
    return kept.withColumn("status", F.when(F.col("place") != F.col("_first"), "duplicate").otherwise(F.col("status"))).drop("_key", "_first")


def located(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """(wid, place, by): where a wanted paper's files lie. wanted: wid, name (the folder's name that its id would have), aliases, year.

    First comes the folder of that `name` if it has a chunk file; then one whose name is an `alias` of the paper; then one that holds the same paper by `identity`, that is
    shares an alias, a title only if not both years are known and different; last the folder of that name without a chunk file (`empty`). Of
    several the least place; papers that are nowhere have no row. The least place of each name, and of each year of a title, is known before names meet, so
    that the many that share one are never paired."""
    want = wanted.select("wid", "name", "aliases", F.col("year").alias("wanted_year"))
    pick = lambda n, by: F.struct(F.lit(n).alias("n"), F.col("place"), F.lit(by).alias("by")).alias("pick")
    least = lambda rows, *by: rows.groupBy(*by).agg(F.min("place").alias("place"))
    folders = least(places, "folder", "has_file")
    named = want.join(folders, F.col("name") == F.col("folder")).select("wid", F.when(F.col("has_file"), pick(1, "name")).otherwise(pick(4, "empty")).alias("pick"))
    spelled: Column = F.explode(F.array_distinct(want["aliases"])).alias("alias")
    mine = want.select("wid", "wanted_year", spelled)
    alias = mine.join(least(places, "folder"), F.col("alias") == F.col("folder")).select("wid", pick(2, "alias"))
    year = lambda y: F.coalesce(F.col(y).cast("string"), F.lit("unknown"))
    is_title = lambda: F.startswith("alias", F.lit("title:"))
    theirs = places.select("place", "year", "folder", F.explode("aliases").alias("alias")).where("alias <> folder")
    theirs = least(theirs.select("place", "alias", F.explode(F.when(is_title(), F.array(F.lit("any"), year("year"))).otherwise(F.array(F.lit("any")))).alias("at")), "alias", "at")
    ways = F.when(is_title() & F.col("wanted_year").isNotNull(), F.array(year("wanted_year"), F.lit("unknown"))).otherwise(F.array(F.lit("any")))
    same = mine.select("wid", "alias", F.explode(ways).alias("at")).join(theirs, ["alias", "at"]).select("wid", pick(3, "identity"))
    return named.unionByName(alias).unionByName(same).groupBy("wid").agg(F.min("pick").alias("pick")).select("wid", "pick.place", "pick.by")
