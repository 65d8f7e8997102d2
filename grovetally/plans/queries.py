"""Every query of the engine over the test tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as p
from ..operators import asof, diff, hierarchy, history, layout, probes, search, sizes
from ..scratch import Scratch
from ..sources import adapters as a
from ..sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ORDERS = """files AS (SELECT r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey AS path, 'file' AS entry_kind, o_orderkey AS file_id,
 CAST(round(o_totalprice * 100) AS BIGINT) AS logical_size,
 CASE WHEN o_orderkey % 97 <> 0 THEN (CAST(round(o_totalprice * 100) AS BIGINT) + 4095) // 4096 * 4096 END AS allocated_size
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PARTS = """files AS (SELECT l_suppkey || '/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey AS path, 'file' AS entry_kind, l_partkey AS file_id,
 CAST(round(p_retailprice * 100) AS BIGINT) AS logical_size, CASE WHEN p_size % 17 <> 0 THEN CAST(p_size AS BIGINT) * 4096 END AS allocated_size
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CONFLICT = PARTS.replace("CAST(round(p_retailprice * 100) AS BIGINT)", "CAST(l_linenumber * 1000 + l_partkey AS BIGINT)")
PAGES = """files AS (SELECT array_to_string(list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda s: s <> ''), '/') AS path, 'file' AS entry_kind,
 page_id AS file_id, CAST(length(html) AS BIGINT) AS logical_size, CAST(length(html) AS BIGINT) AS allocated_size FROM pages)"""
SPREAD = """parts AS (SELECT *, string_split(path, '/') AS s FROM files),
spread AS (SELECT path, file_id, logical_size, allocated_size, CASE WHEN i = 0 THEN '.' ELSE array_to_string(s[1:i], '/') END AS dir
 FROM (SELECT *, unnest(range(len(s))) AS i FROM parts))"""
SUMMED = """nodes AS (SELECT dir AS path, CAST(sum(logical_size) AS BIGINT) AS value_logical,
 CASE WHEN count(*) = count(allocated_size) THEN CAST(sum(allocated_size) AS BIGINT) END AS value_allocated, count(*) AS item_count FROM spread GROUP BY dir)"""
ALL_NODES = """every AS (SELECT path, value_logical, value_allocated, item_count FROM nodes UNION ALL SELECT path, logical_size, allocated_size, 1 FROM files)"""
UP = "CASE WHEN path = '.' THEN NULL WHEN strpos(path, '/') = 0 THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"
NAME = "regexp_extract(path, '([^/]*)$', 1)"
EXT = f"CASE WHEN regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1) = '' THEN '(no ext)' ELSE lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1)) END"
PART_DIRS = """dirs AS (SELECT '.' AS listed UNION SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem UNION SELECT l_suppkey || '/' || l_orderkey FROM lineitem WHERE l_orderkey % 7 <> 0)"""
UNIQUE = f"""{PART_DIRS}, once AS (SELECT *, row_number() OVER (PARTITION BY dir, file_id ORDER BY path) AS k FROM spread)
SELECT listed AS path, CAST(coalesce(sum(logical_size), 0) AS BIGINT) AS unique_logical, CASE WHEN count(file_id) = count(allocated_size) THEN CAST(coalesce(sum(allocated_size), 0) AS BIGINT) END AS unique_allocated,
 count(file_id) AS unique_files FROM dirs LEFT JOIN (SELECT * FROM once WHERE k = 1) AS o ON listed = dir GROUP BY listed"""
LATER = """later AS (SELECT CASE WHEN file_id % 13 = 0 THEN path || 'x' ELSE path END AS path, entry_kind, CASE WHEN file_id % 19 = 0 THEN file_id + 1 ELSE file_id END AS file_id,
 CASE WHEN file_id % 7 = 0 THEN logical_size + 1 ELSE logical_size END AS logical_size, CASE WHEN file_id % 17 <> 0 THEN allocated_size END AS allocated_size
 FROM files WHERE file_id % 11 <> 0)"""
OMAP = """omap AS (SELECT user_id AS oid, event_id AS xid, event_id * 7 AS paddr, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE CASE WHEN event_id % 23 = 0 THEN 4 ELSE 0 END END AS flags FROM events)"""
EXTENTS = """fe AS (SELECT DISTINCT l_suppkey || '-' || l_partkey || '-' || l_orderkey || '-' || l_linenumber AS row_id, l_orderkey * 8 + l_linenumber AS ls, l_orderkey * 8 + l_linenumber + 1 + l_partkey % 12 AS le, l_partkey FROM lineitem),
pe AS (SELECT o_orderkey * 8 AS rs, o_orderkey * 8 + 8 AS re, o_custkey % 4 AS refcnt FROM orders WHERE o_orderkey % 5 <> 0)"""
STATES = """states AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1, 2)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def with_leaves(entries: DataFrame) -> DataFrame:
    """Directories and leaves with their totals."""
    leaves = entries.select("path", F.col("logical_size").alias("value_logical"), F.col("allocated_size").alias("value_allocated"), F.lit(1).cast("long").alias("item_count"))
    return hierarchy.path_summed(entries).unionByName(leaves)


def stored_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of the order namespace: path, parent, name, depth and totals, in order of path.

    A scan's tree is built once and then asked many times: the table is written to the
    shared folder for each state of its input files and read back by every search.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    state = [folder]
    for name in ("orders", "customer", "nation", "region"):
        where = path(f"{folder}/{name}.parquet")
        for f in where.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(where):
            state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    made = context.__dict__.setdefault("_grovetally_nodes", {})
    if str(state) not in made:
        nodes = with_leaves(a.ns_orders(spark, folder))
        nodes = nodes.select(*nodes.columns, p.parent(F.col("path")).alias("parent"), p.basename(F.col("path")).alias("name"), p.depth(F.col("path")).alias("depth"))
        made[str(state)] = Scratch(spark, "nodes").keep(nodes.repartitionByRange("path").sortWithinPartitions("path"), "nodes")
    return made[str(state)]


@query(f"WITH {ORDERS}, {SPREAD}, {SUMMED} SELECT * FROM nodes")
def dir_rollup_path_summed(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.path_summed(a.ns_orders(spark, folder))


@query(f"WITH {PARTS}, {SPREAD}, {UNIQUE}")
def dir_rollup_unique_inode(spark, folder):
    return hierarchy.unique_inode(a.ns_parts(spark, folder, directories=True))


@query(f"WITH {CONFLICT}, {SPREAD}, {UNIQUE}")
def dir_rollup_first_path_wins(spark, folder):
    return hierarchy.unique_inode(a.ns_parts(spark, folder, conflict=True, directories=True))


@query(f"WITH {PARTS}, {SPREAD}, {SUMMED} SELECT path, value_allocated, value_allocated IS NULL AS unclaimed FROM nodes")
def dir_rollup_null_collapse(spark, folder):
    return hierarchy.path_summed(a.ns_parts(spark, folder)).select("path", "value_allocated", F.col("value_allocated").isNull().alias("unclaimed"))


@query(f"WITH {PARTS}, {SPREAD}, {PART_DIRS} SELECT DISTINCT dir AS path, file_id FROM spread JOIN dirs ON dir = listed")
def dir_contributing_ids(spark, folder):
    return hierarchy.contributions(a.ns_parts(spark, folder, directories=True)).select("path", "file_id")


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED} SELECT (SELECT count(*) FROM files) AS entries, (SELECT count(*) FROM files) + (SELECT count(*) FROM nodes) AS nodes,
 value_logical, value_allocated FROM nodes WHERE path = '.'""")
def scan_totals(spark, folder):
    entries = a.ns_orders(spark, folder)
    nodes = with_leaves(entries)
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.max(F.when(F.col("path") == p.ROOT, F.struct("value_logical", "value_allocated", "item_count"))).alias("root"))
    return counts.select(F.col("root.item_count").alias("entries"), "nodes", "root.value_logical", "root.value_allocated")


@query(f"WITH {PARTS} SELECT bool_or(allocated_size IS NOT NULL) AS allocated_available, bool_or(logical_size IS NOT NULL) AS logical_available, false AS real_available FROM files")
def metric_availability(spark, folder):
    available = lambda c: F.bool_or(F.col(c).isNotNull()).alias(c.replace("_size", "_available"))
    return a.ns_parts(spark, folder).withColumn("real_size", F.lit(None).cast("long")).agg(*(available(c) for c in ("allocated_size", "logical_size", "real_size")))


@query(f"""WITH {PAGES}, g AS (SELECT {EXT} AS ext, CAST(sum(logical_size) AS BIGINT) AS value_logical, CASE WHEN count(*) = count(allocated_size) THEN CAST(sum(allocated_size) AS BIGINT) END AS value_allocated,
 count(*) AS file_count FROM files GROUP BY 1) SELECT *, row_number() OVER (ORDER BY value_logical DESC, ext) AS rank, CAST(sum(value_logical) OVER () AS BIGINT) AS total FROM g""")
def ext_summary(spark, folder):
    found = search.by_extension(a.ns_pages(spark, folder))
    # One row for each extension reaches these windows.
    order = Window.orderBy(F.col("value_logical").desc(), "ext")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("total", F.sum("value_logical").over(Window.partitionBy()).cast("long"))


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED}, {ALL_NODES}, r AS (SELECT path, {UP} AS parent, value_logical, row_number() OVER (PARTITION BY {UP} ORDER BY value_logical DESC, {NAME}) AS rank,
 count(*) OVER (PARTITION BY {UP}) AS n FROM every WHERE path <> '.') SELECT parent, path, value_logical, rank, greatest(n - 5, 0) AS overflow FROM r WHERE rank <= 5""")
def top_children(spark, folder):
    found = hierarchy.top_children(stored_nodes(spark, folder), "value_logical", 5)
    return found.select("parent", "path", "value_logical", F.col("rank").cast("long").alias("rank"), "overflow")


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED}, {ALL_NODES} SELECT path, value_logical FROM every WHERE contains(lower(CASE WHEN path = '.' THEN '' ELSE {NAME} END), 'a')""")
def search_matches(spark, folder):
    return search.matches(stored_nodes(spark, folder), "A").select("path", "value_logical")


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED}, {ALL_NODES}, m AS (SELECT path, string_split(path, '/') AS s FROM every WHERE contains(lower({NAME}), '99') AND path <> '.')
 SELECT DISTINCT path FROM (SELECT path FROM m UNION ALL SELECT '.' UNION ALL SELECT CASE WHEN i = 0 THEN '.' ELSE array_to_string(s[1:i], '/') END FROM (SELECT s, unnest(range(len(s))) AS i FROM m)) AS t(path)""")
def search_keep_set(spark, folder):
    return search.keep_set(stored_nodes(spark, folder), "99")


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED}, {ALL_NODES}, m AS (SELECT path, value_logical FROM every WHERE contains(lower({NAME}), 'customer') AND path <> '.')
 SELECT path, value_logical, (SELECT count(*) FROM m) AS total FROM m ORDER BY value_logical DESC, path LIMIT 20""")
def top_search_hits(spark, folder):
    return search.top_hits(stored_nodes(spark, folder), "Customer", "value_logical", 20).select("path", "value_logical", "total")


@query(f"WITH {ORDERS} SELECT path, logical_size FROM files WHERE path = 'ASIA' OR path LIKE 'ASIA/%'")
def subtree_filter(spark, folder):
    return a.ns_orders(spark, folder).filter(p.inside(F.col("path"), "ASIA")).select("path", "logical_size")


@query(f"WITH {ORDERS}, {SPREAD}, {SUMMED} SELECT path, value_logical FROM nodes WHERE path = '.' OR len(string_split(path, '/')) <= 2")
def depth_cap(spark, folder):
    return stored_nodes(spark, folder).filter("depth <= 2").select("path", "value_logical")


@query(f"WITH {ORDERS}, {SPREAD}, {SUMMED} SELECT asked, path, value_logical FROM nodes JOIN (VALUES ('/ASIA//', 'ASIA'), ('', '.'), ('EUROPE/', 'EUROPE'), ('/', '.')) AS q(asked, wanted) ON path = wanted")
def path_lookup(spark, folder):
    asked = spark.createDataFrame([("/ASIA//",), ("",), ("EUROPE/",), ("/",)], "asked string").withColumn("path", p.normalised(F.col("asked")))
    return stored_nodes(spark, folder).join(F.broadcast(asked), "path").select("asked", "path", "value_logical")


@query(f"WITH {ORDERS}, {SPREAD} SELECT path, string_agg(dir, '>' ORDER BY length(CASE WHEN dir = '.' THEN '' ELSE dir END)) AS chain FROM spread GROUP BY path")
def ancestor_chain(spark, folder):
    return a.ns_orders(spark, folder).select("path", F.array_join(p.ancestors(F.col("path")), ">").alias("chain"))


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED}, {ALL_NODES}, q AS (SELECT path, value_logical, {UP} AS up FROM every)
 SELECT q.path, CASE WHEN n.value_logical > 0 THEN q.value_logical * 10000 // n.value_logical END AS percent_x100 FROM q LEFT JOIN nodes n ON q.up = n.path""")
def percent_of_parent(spark, folder):
    return hierarchy.percent_of_parent(stored_nodes(spark, folder), "value_logical")


REASONS = "CASE event_type WHEN 'error' THEN 'permission_denied' WHEN 'view' THEN 'not_found' WHEN 'click' THEN 'mount_boundary' ELSE 'read_error:Other' END"


@query(f"""WITH s AS (SELECT 'p/' || event_id AS path, {REASONS} AS reason FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS k, count(*) OVER (PARTITION BY reason) AS n FROM s)
 SELECT reason, n, string_agg(path, ',' ORDER BY path) AS paths, greatest(n - 5, 0) AS overflow FROM r WHERE k <= 5 GROUP BY reason, n""")
def skip_histogram(spark, folder):
    skips = a.table(spark, folder, "events").select(F.concat(F.lit("p/"), F.col("event_id").cast("string")).alias("path"), F.expr(REASONS).alias("reason"))
    return probes.skip_samples(skips)


def _scans(spark, folder):
    before = a.ns_orders(spark, folder)
    return before, a.later_scan(before)


_FIELDS = ["entry_kind", "logical_size", "allocated_size"]
_CHANGES = f"""WITH {ORDERS}, {LATER}, j AS (SELECT l.path AS lp, r.path AS rp, coalesce(l.path, r.path) AS path, l.logical_size AS ll, r.logical_size AS rl, l.allocated_size AS la, r.allocated_size AS ra,
 l.file_id AS li, r.file_id AS ri FROM files l FULL OUTER JOIN later r ON l.path = r.path),
d AS (SELECT path, 'logical_size' AS field, CAST(ll AS VARCHAR) AS left_value, CAST(rl AS VARCHAR) AS right_value FROM j WHERE lp IS NOT NULL AND rp IS NOT NULL AND ll IS DISTINCT FROM rl
 UNION ALL SELECT path, 'allocated_size', CAST(la AS VARCHAR), CAST(ra AS VARCHAR) FROM j WHERE lp IS NOT NULL AND rp IS NOT NULL AND la IS DISTINCT FROM ra
 UNION ALL SELECT path, 'only_in_left', NULL, NULL FROM j WHERE rp IS NULL UNION ALL SELECT path, 'only_in_right', NULL, NULL FROM j WHERE lp IS NULL)"""
_IDS = "i AS (SELECT path, 'file_id' AS field, CAST(li AS VARCHAR) AS left_value, CAST(ri AS VARCHAR) AS right_value FROM j WHERE lp IS NOT NULL AND rp IS NOT NULL AND li <> ri)"


@query(f"{_CHANGES} SELECT * FROM d")
def scan_diff_long(spark, folder):
    return diff.long_form(*_scans(spark, folder), _FIELDS)


@query(f"""{_CHANGES}, x AS (SELECT path, field, left_value AS right_value, right_value AS left_value FROM d) SELECT path, field, left_value, right_value FROM x WHERE field IN ('logical_size', 'allocated_size')
 UNION ALL SELECT path, 'only_in_left', NULL, NULL FROM x WHERE field = 'only_in_right'""")
def scan_diff_last_row(spark, folder):
    """A listing that a later one was added to, against the first: of two rows of a path the later counts."""
    before, after = _scans(spark, folder)
    both = before.withColumn("seq", F.lit(0)).unionByName(after.withColumn("seq", F.lit(1)))
    return diff.long_form(both, before.withColumn("seq", F.lit(0)), _FIELDS, order="seq")


@query(f"{_CHANGES} SELECT field, count(*) AS n FROM d GROUP BY field")
def scan_diff_summary(spark, folder):
    return diff.summary(diff.long_form(*_scans(spark, folder), _FIELDS))


@query(f"WITH {ORDERS}, {LATER} SELECT path FROM files EXCEPT SELECT path FROM later")
def only_in_left(spark, folder):
    return diff.only_in(*_scans(spark, folder))


@query(f"WITH {ORDERS}, {LATER} SELECT path FROM later EXCEPT SELECT path FROM files")
def only_in_right(spark, folder):
    return diff.only_in(*_scans(spark, folder)[::-1])


@query(f"{_CHANGES}, {_IDS} SELECT * FROM i UNION ALL SELECT * FROM d WHERE field <> 'allocated_size'")
def oracle_diff(spark, folder):
    return diff.long_form(*_scans(spark, folder), ["entry_kind", "file_id", "logical_size"])


@query(f"{_CHANGES}, {_IDS} SELECT * FROM (SELECT * FROM i UNION ALL SELECT * FROM d) AS t ORDER BY path, field LIMIT 50")
def snapshot_diff(spark, folder):
    return diff.long_form(*_scans(spark, folder), ["entry_kind", "file_id", "logical_size", "allocated_size"]).orderBy("path", "field").limit(50)


@query(f"WITH {ORDERS}, {LATER} SELECT path, entry_kind, logical_size FROM files INTERSECT SELECT path, entry_kind, logical_size FROM later")
def unchanged_rows(spark, folder):
    before, after = _scans(spark, folder)
    names = ["path", "entry_kind", "logical_size"]
    return before.select(names).intersect(after.select(names))


@query(f"WITH {ORDERS}, {PARTS.replace('files AS', 'parts AS')} SELECT path, entry_kind, file_id, logical_size, allocated_size FROM files UNION ALL SELECT path, entry_kind, file_id, logical_size, allocated_size FROM parts")
def union_scans(spark, folder):
    return a.ns_orders(spark, folder).unionByName(a.ns_parts(spark, folder))


_REJECT = "CASE WHEN flags & 28 <> 0 THEN 'unsupported_flags' END AS reject"
_LAST = "(SELECT *, row_number() OVER (PARTITION BY oid ORDER BY xid DESC) AS k FROM omap WHERE xid <= (SELECT max(event_id) // 2 FROM events)) AS t"


def _half(spark, folder) -> int:
    return a.table(spark, folder, "events").agg(F.max("event_id")).first()[0] // 2


@query(f"WITH {OMAP} SELECT oid, xid, paddr, flags, {_REJECT} FROM {_LAST} WHERE k = 1 AND flags & 1 = 0")
def asof_lookup(spark, folder):
    return asof.as_of(a.omap(spark, folder), _half(spark, folder)).select("oid", "xid", "paddr", "flags", "reject")


@query(f"WITH {OMAP} SELECT oid FROM {_LAST} WHERE k = 1 AND flags & 1 <> 0")
def asof_tombstone(spark, folder):
    versions, most = a.omap(spark, folder), _half(spark, folder)
    return versions.filter(F.col("xid") <= most).select("oid").distinct().join(asof.as_of(versions, most).select("oid"), "oid", "left_anti")


@query(f"""WITH {OMAP}, probes AS (SELECT o_orderkey AS probe_id, o_custkey % 150 AS oid, o_orderkey % (SELECT max(event_id) FROM events) AS most FROM orders),
 m AS (SELECT probe_id, p.oid, xid, paddr, flags, row_number() OVER (PARTITION BY probe_id ORDER BY xid DESC) AS k FROM probes p JOIN omap o ON p.oid = o.oid AND o.xid <= p.most)
 SELECT probe_id, oid, xid, paddr, flags, {_REJECT} FROM m WHERE k = 1 AND flags & 1 = 0""")
def asof_join(spark, folder):
    last = a.table(spark, folder, "events").agg(F.max("event_id")).first()[0]
    probes = a.table(spark, folder, "orders").select(F.col("o_orderkey").alias("probe_id"), (F.col("o_custkey") % 150).alias("oid"), (F.col("o_orderkey") % last).alias("most"))
    return asof.as_of_each(probes, a.omap(spark, folder))


@query(f"""WITH {OMAP}, h AS (SELECT max(event_id) // 2 AS m FROM events) SELECT count(*) FILTER (WHERE xid <= m) AS mapping_count, max(CASE WHEN xid <= m THEN xid END) AS max_observed_xid,
 count(*) FILTER (WHERE flags & 1 <> 0) AS n_deleted, count(*) FILTER (WHERE flags & 2 <> 0) AS n_saved, count(*) FILTER (WHERE flags & 4 <> 0) AS n_encrypted,
 count(*) FILTER (WHERE flags & 8 <> 0) AS n_noheader, count(*) FILTER (WHERE flags & 16 <> 0) AS n_crypto_generation FROM omap, h""")
def omap_summary(spark, folder):
    return asof.summarise(a.omap(spark, folder), _half(spark, folder))


@query(f"WITH {OMAP} SELECT oid, xid, paddr FROM omap WHERE xid <= (SELECT max(event_id) // 2 FROM events) ORDER BY oid, xid LIMIT 8")
def omap_sample(spark, folder):
    return a.omap(spark, folder).filter(F.col("xid") <= _half(spark, folder)).orderBy("oid", "xid").limit(8).select("oid", "xid", "paddr")


@query("SELECT user_id AS xid, event_id AS descriptor_index, event_id * 3 AS block FROM events WHERE event_type <> 'error' ORDER BY user_id DESC, event_id DESC LIMIT 1")
def latest_checkpoint(spark, folder):
    events = a.table(spark, folder, "events")
    return asof.latest(events.select(F.col("user_id").alias("xid"), F.col("event_id").alias("descriptor_index"), (F.col("event_id") * 3).alias("block"), (F.col("event_type") != "error").alias("valid")))


_SHARED = """bytes AS (SELECT row_id, min(l_partkey) AS l_partkey, CAST(sum(CASE WHEN rs IS NULL THEN 0 ELSE (least(le, re) - greatest(ls, rs)) * 4096 // (CASE WHEN refcnt > 0 THEN refcnt ELSE 1 END) END)
 + (min(le - ls) - sum(CASE WHEN rs IS NULL THEN 0 ELSE least(le, re) - greatest(ls, rs) END)) * 4096 AS BIGINT) AS bytes FROM fe LEFT JOIN pe ON ls < re AND rs < le GROUP BY row_id)"""


@query(f"WITH {EXTENTS}, {_SHARED} SELECT row_id, bytes FROM bytes")
def extent_dedup(spark, folder):
    return sizes.shared_bytes(*a.extents(spark, folder), 4096)


@query(f"WITH {EXTENTS} SELECT row_id, greatest(ls, rs) AS s, least(le, re) AS e FROM fe JOIN pe ON ls < re AND rs < le")
def extent_overlaps(spark, folder):
    return sizes.overlaps(*a.extents(spark, folder), 64).select("row_id", F.greatest("ls", "rs").alias("s"), F.least("le", "re").alias("e"))


@query(f"""WITH {EXTENTS}, {_SHARED}, totals AS (SELECT l_partkey AS stream_id, CAST(sum(bytes) AS BIGINT) AS total FROM bytes GROUP BY 1),
 owners AS (SELECT DISTINCT l_partkey AS stream_id, l_partkey AS file_id, greatest(l_partkey % 4, 1) AS refs FROM lineitem UNION SELECT DISTINCT l_partkey, l_partkey + 1000000, greatest(l_partkey % 4, 1) FROM lineitem)
 SELECT file_id, total // refs + CASE WHEN file_id = o.stream_id THEN total % refs ELSE 0 END AS real_size FROM owners o JOIN totals t ON o.stream_id = t.stream_id""")
def real_size(spark, folder):
    """Every stream is a file's own and a clone's; none counts once where its count is 0."""
    files, blocks = a.extents(spark, folder)
    streams = files.select("row_id", F.split("row_id", "-")[1].cast("long").alias("stream_id"))
    totals = sizes.shared_bytes(files, blocks, 4096).join(streams, "row_id").groupBy("stream_id").agg(p.full_sum(F.col("bytes")).alias("bytes")).withColumn("refcnt", F.col("stream_id") % 4)
    owners = streams.select("stream_id").distinct().select("stream_id", F.explode(F.array("stream_id", F.col("stream_id") + 1000000)).alias("file_id"))
    return sizes.real_size(totals, owners)


_INODES = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'symlink' WHEN p_size % 7 = 0 THEN 'dir' ELSE 'file' END AS kind, p_size % 11 <> 0 AS has_inode, p_size % 3 = 0 AS compressed, p_name, CAST(p_size AS BIGINT) AS size FROM part"


@query(f"""SELECT p_partkey, CASE WHEN kind = 'symlink' THEN strlen(p_name) WHEN kind <> 'file' OR NOT has_inode THEN 0 WHEN compressed THEN CASE WHEN size % 2 = 0 THEN size * 100 ELSE 0 END
 WHEN size % 13 = 0 THEN 0 ELSE size * 1000 END AS logical_size FROM ({_INODES}) AS t""")
def logical_precedence(spark, folder):
    rows = _inodes(spark, folder)
    size = F.col("size")
    rule = sizes.logical_size(F.col("kind"), F.col("has_inode"), F.col("p_name"), F.col("compressed"), F.when(size % 2 == 0, size * 100), F.when(size % 13 != 0, size * 1000))
    return rows.select("p_partkey", rule.alias("logical_size"))


@query(f"""SELECT p_partkey, CASE WHEN kind IN ('symlink', 'dir') THEN 0 WHEN NOT has_inode THEN NULL WHEN compressed THEN size * 4096 + CASE WHEN size % 2 = 0 THEN 4096 ELSE 0 END
 WHEN size % 4 = 0 THEN greatest(size * 4096 - 65536, 0) WHEN size % 13 = 0 THEN NULL ELSE size * 4096 END AS allocated_size FROM ({_INODES}) AS t""")
def allocated_precedence(spark, folder):
    rows = _inodes(spark, folder)
    size = F.col("size")
    own = F.when(F.col("compressed") | (size % 4 == 0) | (size % 13 != 0), size * 4096)
    rule = sizes.allocated_size(F.col("kind"), F.col("has_inode"), F.col("compressed"), own, F.when(size % 2 == 0, 4096), F.lit(None).cast("long"), F.when(size % 4 == 0, 65536))
    return rows.select("p_partkey", rule.alias("allocated_size"))


def _inodes(spark, folder):
    size = F.col("p_size").cast("long")
    kind = F.when(size % 5 == 0, "symlink").when(size % 7 == 0, "dir").otherwise("file")
    return a.table(spark, folder, "part").select("p_partkey", kind.alias("kind"), (size % 11 != 0).alias("has_inode"), (size % 3 == 0).alias("compressed"), "p_name", size.alias("size"))


# Names of record families by type, and those in the namespace's scope.
FAMILIES = ["any", "snap_metadata", "extent", "inode", "xattr", "sibling_link", "dstream_id", "crypto_state", "file_extent", "dir_rec", "dir_stats", "snap_name", "sibling_map", "file_info"]
IN_SCOPE = (3, 4, 5, 6, 9, 12)


@query(f"""SELECT raw_type, family, in_scope, count(*) AS n, count(DISTINCT object_id) AS objects FROM (SELECT event_id % 16 AS raw_type, user_id AS object_id,
 CASE event_id % 16 {' '.join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAMILIES))} ELSE 'unknown' END AS family, event_id % 16 IN (3, 4, 5, 6, 9, 12) AS in_scope FROM events) AS t GROUP BY 1, 2, 3""")
def family_counts(spark, folder):
    records = a.table(spark, folder, "events").select((F.col("event_id") % 16).alias("raw_type"), F.col("user_id").alias("object_id"))
    names = F.coalesce(F.get(F.array(*(F.lit(f) for f in FAMILIES)), F.col("raw_type").cast("int")), F.lit("unknown"))
    named = records.withColumn("family", names).withColumn("in_scope", F.col("raw_type").isin(*IN_SCOPE))
    return named.groupBy("raw_type", "family", "in_scope").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("object_id").alias("objects"))


def _edges(spark, folder):
    """Region, nation, customer and order as a tree below id 2; ids tell the level apart."""
    t = lambda name: a.table(spark, folder, name)
    row = lambda frame, up, name, own, kind: frame.select(up.cast("long").alias("parent_id"), name.cast("string").alias("name"), own.cast("long").alias("file_id"), F.lit(kind).alias("entry_kind"))
    c = F.col
    return (
        row(t("region"), F.lit(2), c("r_name"), c("r_regionkey") * 10 + 3, "dir")
        .unionByName(row(t("nation"), c("n_regionkey") * 10 + 3, c("n_name"), c("n_nationkey") * 10 + 4, "dir"))
        .unionByName(row(t("customer"), c("c_nationkey") * 10 + 4, c("c_name"), c("c_custkey") * 10 + 5, "dir"))
        .unionByName(row(t("orders"), c("o_custkey") * 10 + 5, c("o_orderkey"), c("o_orderkey") * 10 + 6, "file"))
    )


@query("""WITH RECURSIVE edges AS (SELECT 2 AS parent_id, r_name AS name, r_regionkey * 10 + 3 AS file_id, 'dir' AS entry_kind FROM region
 UNION ALL SELECT n_regionkey * 10 + 3, n_name, n_nationkey * 10 + 4, 'dir' FROM nation UNION ALL SELECT c_nationkey * 10 + 4, c_name, c_custkey * 10 + 5, 'dir' FROM customer
 UNION ALL SELECT o_custkey * 10 + 5, CAST(o_orderkey AS VARCHAR), o_orderkey * 10 + 6, 'file' FROM orders),
 w AS (SELECT name AS path, CAST(file_id AS BIGINT) AS file_id, entry_kind, 1 AS depth FROM edges WHERE parent_id = 2 UNION ALL SELECT w.path || '/' || e.name, CAST(e.file_id AS BIGINT), e.entry_kind, w.depth + 1 FROM w JOIN edges e ON e.parent_id = w.file_id WHERE w.entry_kind = 'dir')
 SELECT path, file_id, entry_kind, depth FROM w""")
def tree_expand(spark, folder):
    return hierarchy.expand_edges(_edges(spark, folder), 2)[0]


@query("""SELECT r_name || '/' || n_name || '/' || c_name || '/loop' AS path, 'drec_cycle(file_id=3)' AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 50 = 0""")
def tree_expand_cycle(spark, folder):
    """A customer that is also a directory of its own orders' region: told, not followed."""
    back = a.table(spark, folder, "customer").filter("c_custkey % 50 = 0").select(
        (F.col("c_custkey") * 10 + 5).alias("parent_id"), F.lit("loop").alias("name"), F.lit(3).cast("long").alias("file_id"), F.lit("dir").alias("entry_kind")
    )
    return hierarchy.expand_edges(_edges(spark, folder).unionByName(back), 2)[1]


_DIRS = "SELECT s_suppkey AS k, 'v' || (s_suppkey % 10) || '/d' || s_suppkey AS path, s_suppkey // 2 AS file_id FROM supplier"


@query(f"SELECT min(path) AS path, file_id FROM ({_DIRS}) AS t GROUP BY file_id")
def dir_identity_dedup(spark, folder):
    from ..sources.posix import one_path_per_directory

    return one_path_per_directory(_linked_dirs(spark, folder))[0].select("path", "file_id")


@query(f"SELECT path, 'duplicate_dir_inode' AS reason FROM (SELECT path, row_number() OVER (PARTITION BY file_id ORDER BY path) AS k FROM ({_DIRS}) AS t) AS u WHERE k > 1")
def dir_identity_skips(spark, folder):
    from ..sources.posix import one_path_per_directory

    return one_path_per_directory(_linked_dirs(spark, folder))[1]


def _linked_dirs(spark, folder):
    key = F.col("s_suppkey")
    path = F.concat(F.lit("v"), (key % 10).cast("string"), F.lit("/d"), key.cast("string"))
    return a.table(spark, folder, "supplier").select(path.alias("path"), F.expr("s_suppkey div 2").alias("file_id"), F.lit("dir").alias("entry_kind"))


@query(f"WITH {ORDERS} SELECT path, entry_kind, logical_size, CAST(NULL AS VARCHAR) AS symlink_target FROM files")
def slim_projection(spark, folder):
    return sinks.slim(a.ns_orders(spark, folder).withColumn("symlink_target", F.lit(None).cast("string")))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id & 1 <> 0 THEN 'deleted' END, CASE WHEN event_id & 2 <> 0 THEN 'saved' END, CASE WHEN event_id & 4 <> 0 THEN 'encrypted' END,
 CASE WHEN event_id & 8 <> 0 THEN 'noheader' END, CASE WHEN event_id & 16 <> 0 THEN 'crypto_generation' END], lambda x: x IS NOT NULL), ',') AS labels FROM events""")
def flag_labels(spark, folder):
    return a.table(spark, folder, "events").select("event_id", p.labels(F.col("event_id"), asof.FLAG_NAMES).alias("labels"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'dir' WHEN o_orderkey % 4 = 1 THEN 'file' WHEN o_orderkey % 4 = 2 THEN 'symlink' ELSE 'other' END AS kind FROM orders")
def kind_of_mode(spark, folder):
    mode = F.element_at(F.array(*(F.lit(m) for m in (0o040755, 0o100644, 0o120777, 0o010600))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return a.table(spark, folder, "orders").select("o_orderkey", p.kind_of_mode(mode).alias("kind"))


@query("SELECT doc_id, md5(regexp_replace(text, '[aeiou]', '', 'g')) AS digest FROM documents")
def sanitize_display(spark, folder):
    """Vowels turned into control characters go the way of all control characters."""
    noisy = F.translate("text", "aeiou", "\x01\x07\x1b\x7f\x9f")
    shown = p.sanitised(noisy)
    return a.table(spark, folder, "documents").select("doc_id", F.md5(F.encode(F.regexp_replace(shown, "�", ""), "UTF-8")).alias("digest"))


@query(f"""WITH {STATES}, l AS (SELECT user_id, day, n, last_type, lag(n) OVER w AS pn, lag(last_type) OVER w AS pt, row_number() OVER w AS k FROM states WINDOW w AS (PARTITION BY user_id ORDER BY day))
 SELECT user_id, day, n IS NOT DISTINCT FROM pn AS same_n, last_type IS NOT DISTINCT FROM pt AS same_last_type FROM l WHERE k > 1""")
def state_changes(spark, folder):
    return history.changes(a.states(spark, folder), "user_id", "day", ["n", "last_type"])


@query(f"WITH {STATES} SELECT user_id, string_agg(n || ':' || last_id || ':' || last_type, '|' ORDER BY day) AS history FROM states GROUP BY user_id")
def path_history(spark, folder):
    return history.path_history(a.states(spark, folder), "user_id", "day", ["n", "last_id", "last_type"])


_NODES = "SELECT DISTINCT event_id // 500 AS state_no, user_id AS node_key FROM events"


@query(f"""WITH nodes AS (SELECT event_id // 500 AS state_no, user_id AS node_key, max(event_type) AS summary FROM events GROUP BY 1, 2)
 SELECT c.state_no, count(*) AS nodes, count(b.node_key) AS reused, count(*) FILTER (WHERE b.node_key IS NOT NULL AND c.summary IS DISTINCT FROM b.summary) AS false_reuse
 FROM nodes c LEFT JOIN nodes b ON b.state_no + 1 = c.state_no AND b.node_key = c.node_key WHERE c.state_no > 0 GROUP BY c.state_no""")
def node_reuse(spark, folder):
    nodes = a.table(spark, folder, "events").groupBy(F.expr("event_id div 500").alias("state_no"), F.col("user_id").alias("node_key")).agg(F.max("event_type").alias("summary"))
    return history.node_reuse(nodes)


@query("""SELECT event_type AS query, min(v) AS min_ns, max(v) AS max_ns, CAST(round(median(v) * 2) AS BIGINT) AS median_x2, CAST(floor(avg(v)) AS BIGINT) AS mean_ns, count(*) AS runs
 FROM (SELECT event_type, event_id % 1009 AS v FROM events) AS t GROUP BY event_type""")
def bench_stats(spark, folder):
    runs = a.table(spark, folder, "events").select(F.col("event_type").alias("query"), (F.col("event_id") % 1009).alias("v"))
    return runs.groupBy("query").agg(
        F.min("v").alias("min_ns"), F.max("v").alias("max_ns"), F.round(F.median("v") * 2).cast("long").alias("median_x2"), F.floor(F.avg("v")).alias("mean_ns"), F.count(F.lit(1)).alias("runs")
    )


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED} SELECT bit_xor(CAST('0x' || substr(md5(path || '|' || item_count || '|' || value_logical), 1, 15) AS BIGINT)) AS signature, count(*) AS directories FROM nodes""")
def dir_signature(spark, folder):
    """One signature of all directories, with their item counts and totals in place of times."""
    dirs = hierarchy.path_summed(a.ns_orders(spark, folder))
    return sinks.signature(dirs.select("path", F.col("item_count").alias("mtime_ns"), F.col("value_logical").alias("ctime_ns")))


_SUFFIX = ["rs", "TXT", "xyz", "Xyz", "c", "pages", "webp", "unknown12", "", "h"]
_NAMED = "SELECT p_partkey, p_size, p_size % 10 AS k, list_value('rs', 'TXT', 'xyz', 'Xyz', 'c', 'pages', 'webp', 'unknown12', '', 'h' || p_partkey)[CAST(p_size % 10 + 1 AS INTEGER)] AS ext FROM part"


@query(f"""WITH n AS ({_NAMED}), h AS (SELECT *, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(ext) + 1), lambda i: CAST(ascii(ext[i:i]) AS BIGINT))), lambda x, y: (xor(x, y) * 16777619) & 4294967295) % 360 AS hue FROM n),
 c AS (SELECT *, list_transform([0, 240, 120], lambda t: CAST(floor((0.565 + 0.27 * greatest(0.0, least(1.0, abs(((hue + t) % 360) / 60.0 - 3) - 1))) * 255 + 1e-9) AS BIGINT)) AS rgb FROM h)
 SELECT p_partkey, CASE WHEN p_size % 12 = 11 THEN 3882826 WHEN p_size % 17 = 0 THEN 1975088 WHEN p_size % 17 = 1 THEN 8227481 WHEN p_size % 17 = 2 THEN 5990265 WHEN ext = '' THEN 10134450 WHEN ext = 'rs' THEN 16760991
 WHEN ext = 'TXT' THEN 10536191 WHEN ext = 'c' THEN 12432127 WHEN ext = 'pages' THEN 15681391 WHEN ext = 'webp' THEN 9358054 ELSE rgb[1] * 65536 + rgb[2] * 256 + rgb[3] END AS fill_rgb FROM c""")
def fill_color(spark, folder):
    size = F.col("p_size")
    kind = F.when(size % 17 == 0, "dir").when(size % 17 == 1, "symlink").when(size % 17 == 2, "other").otherwise("file")
    ext = F.get(F.array(*(F.lit(x) if x != "h" else F.concat(F.lit("h"), F.col("p_partkey")) for x in _SUFFIX)), (size % 10).cast("int"))
    name = F.concat(F.lit("a.name"), F.when(ext == "", "").otherwise("."), ext)
    plain = F.when(ext == "", F.lit("no dot")).otherwise(name)
    return a.table(spark, folder, "part").select("p_partkey", layout.fill(plain, kind, size % 12 == 11).alias("fill_rgb"))


@query()
def treemap_cells(spark, folder):
    return layout.cells(stored_nodes(spark, folder), max_depth=2, width=1024.0, height=768.0)


@query(f"""WITH {EXTENTS}, m AS (SELECT row_id, ls, le, greatest(ls, rs) AS s, least(le, re) AS e, CAST(refcnt AS BIGINT) AS refcnt FROM fe JOIN pe ON ls < re AND rs < le
 UNION ALL SELECT row_id, ls, le, le, le, NULL FROM fe), l AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY row_id ORDER BY s, e), ls) AS f FROM m)
 SELECT row_id, s, e, refcnt FROM l WHERE refcnt IS NOT NULL UNION ALL SELECT row_id, f, s, 1 FROM l WHERE f < s""")
def range_split(spark, folder):
    return sizes.split_ranges(*a.extents(spark, folder))


@query(f"""WITH {ORDERS}, {LATER}, c AS (SELECT l.path AS lp, r.path AS rp, coalesce(l.path, r.path) AS path, array_to_string(list_filter([CASE WHEN l.file_id IS DISTINCT FROM r.file_id THEN 'file_id' END,
 CASE WHEN l.logical_size IS DISTINCT FROM r.logical_size THEN 'logical_size' END], lambda x: x IS NOT NULL), ',') AS names FROM files l FULL OUTER JOIN later r ON l.path = r.path)
 SELECT path, CASE WHEN rp IS NULL THEN 'missing' WHEN lp IS NULL THEN 'extra' ELSE names END AS changed FROM c WHERE rp IS NULL OR lp IS NULL OR names <> ''""")
def record_diff(spark, folder):
    return diff.changed_fields(*_scans(spark, folder), ["path"], ["file_id", "logical_size"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'unclaimed' WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN (s * 10 // 1024) // 10 || '.' || (s * 10 // 1024) % 10 || ' KiB'
 WHEN s < 1073741824 THEN (s * 10 // 1048576) // 10 || '.' || (s * 10 // 1048576) % 10 || ' MiB' ELSE (s * 10 // 1073741824) // 10 || '.' || (s * 10 // 1073741824) % 10 || ' GiB' END AS shown
 FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 5000000000 AS s FROM orders) AS t""")
def size_text(spark, folder):
    size = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey") * F.col("o_orderkey") % 5000000000)
    return a.table(spark, folder, "orders").select("o_orderkey", p.size_text(size).alias("shown"))


@query(f"""WITH {ORDERS}, m AS (SELECT n_name AS target, r_name AS link FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0)
 SELECT path, link IS NOT NULL AS is_link, target FROM files LEFT JOIN m ON string_split(path, '/')[1] = link AND string_split(path, '/')[2] = target""")
def link_map(spark, folder):
    nations, regions = a.table(spark, folder, "nation"), a.table(spark, folder, "region")
    links = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 5 = 0").select(F.concat_ws("/", "r_name", "n_name").alias("prefix"), F.col("n_name").alias("target"))
    entries = a.ns_orders(spark, folder).select("path", F.substring_index("path", "/", 2).alias("prefix"))
    return entries.join(links, "prefix", "left").select("path", F.col("target").isNotNull().alias("is_link"), "target")


def _above(below: str, name: str) -> str:
    """SQL of the digests of the directories that hold those of ``below``."""
    return f"""{name} AS (SELECT path, sha256(':' || sha256(string_agg(x, chr(10) ORDER BY child))) AS digest FROM
 (SELECT CASE WHEN strpos(path, '/') = 0 THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS path, path AS child, path || '|' || digest AS x FROM {below}) AS t GROUP BY path)"""


@query(f"""WITH {ORDERS}, l AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, path, CAST('0x' || substr(md5(path), 1, 8) AS BIGINT) % 1024 AS k, path || '|' || entry_kind || '|' || file_id || '|' || logical_size AS x FROM files),
 q AS (SELECT up, k, sha256(string_agg(x, chr(10) ORDER BY path)) AS x FROM l GROUP BY up, k), d3 AS (SELECT up AS path, sha256(sha256(string_agg(x, chr(10) ORDER BY k)) || ':') AS digest FROM q GROUP BY up),
 {_above('d3', 'd2')}, {_above('d2', 'd1')}, {_above('d1', 'd0')} SELECT * FROM d3 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d0""")
def entry_digest(spark, folder):
    """A digest of every directory's listing, of all lines below it."""
    return hierarchy.digests(a.ns_orders(spark, folder), ["entry_kind", "file_id", "logical_size"])


@query(f"WITH {PARTS} SELECT file_id, count(DISTINCT {NAME}) AS names, min({NAME}) AS first_name FROM (SELECT path, file_id FROM files) AS f GROUP BY file_id")
def names_per_inode(spark, folder):
    named = a.ns_parts(spark, folder).withColumn("name", p.basename(F.col("path")))
    return named.groupBy("file_id").agg(F.countDistinct("name").alias("names"), F.min("name").alias("first_name"))


@query("""SELECT user_id AS scan_id, event_id AS seq, CAST(sum(event_id % 7) OVER w AS BIGINT) AS scanned, CAST(sum(event_id % 3) OVER w AS BIGINT) AS skipped, CAST(sum(event_id % 101) OVER w AS BIGINT) AS bytes,
 event_id = max(event_id) OVER (PARTITION BY user_id) AS terminal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def progress_totals(spark, folder):
    from ..streaming import scans

    ticks = a.table(spark, folder, "events").selectExpr("user_id AS scan_id", "event_id AS seq", "event_id % 7 AS scanned", "event_id % 3 AS skipped", "event_id % 101 AS bytes")
    return scans.progress(ticks)


@query("""SELECT event_id, CASE WHEN t > 0 AND d * 1.0 / t <= 1.1 THEN CAST(floor(least(d * 1.0 / t, 1.0) * 1000) AS BIGINT) END AS permille
 FROM (SELECT event_id, event_id % 120 AS d, event_id % 9 * 16 AS t FROM events) AS x""")
def progress_fraction(spark, folder):
    from ..streaming import scans

    share = scans.fraction(F.col("event_id") % 120, F.col("event_id") % 9 * 16)
    return a.table(spark, folder, "events").select("event_id", F.floor(share * 1000).alias("permille"))


@query("""SELECT event_type AS config, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id % 1009 END) AS BIGINT) AS base, CAST(sum(CASE WHEN event_id % 2 = 1 THEN event_id % 1009 END) AS BIGINT) AS changed,
 CASE WHEN abs(count(*) FILTER (WHERE event_id % 2 = 0) - count(*) FILTER (WHERE event_id % 2 = 1)) * 100 > count(*) THEN 'inconclusive'
 WHEN sum(CASE WHEN event_id % 2 = 1 THEN event_id % 1009 END) * 10 < sum(CASE WHEN event_id % 2 = 0 THEN event_id % 1009 END) * 9 THEN 'faster' ELSE 'same' END AS verdict FROM events GROUP BY event_type""")
def bench_verdict(spark, folder):
    runs = a.table(spark, folder, "events").select(F.col("event_type").alias("config"), (F.col("event_id") % 2).alias("variant"), (F.col("event_id") % 1009).alias("v"))
    sums = runs.groupBy("config").agg(
        F.sum(F.when(F.col("variant") == 0, F.col("v"))).alias("base"), F.sum(F.when(F.col("variant") == 1, F.col("v"))).alias("changed"),
        F.count_if(F.col("variant") == 0).alias("n0"), F.count_if(F.col("variant") == 1).alias("n1"),
    )
    drift = F.abs(F.col("n0") - F.col("n1")) * 100 > F.col("n0") + F.col("n1")
    return sums.select("config", "base", "changed", F.when(drift, "inconclusive").when(F.col("changed") * 10 < F.col("base") * 9, "faster").otherwise("same").alias("verdict"))


@query(f"""WITH {ORDERS}, {LATER}, b AS (SELECT count(*) AS n FROM (SELECT path FROM files EXCEPT SELECT path FROM later) AS x), c AS (SELECT count(*) AS n FROM (SELECT path FROM later EXCEPT SELECT path FROM files) AS y),
 k AS (SELECT count(*) AS n FROM files f JOIN later l ON f.path = l.path WHERE f.logical_size <> l.logical_size) SELECT b.n AS gone, c.n AS new, k.n AS resized FROM b, c, k""")
def churn(spark, folder):
    before, after = _scans(spark, folder)
    found = diff.summary(diff.long_form(before, after, ["logical_size"]))
    return found.agg(*(F.coalesce(F.max(F.when(F.col("field") == f, F.col("n"))), F.lit(0)).alias(n) for f, n in (("only_in_left", "gone"), ("only_in_right", "new"), ("logical_size", "resized"))))


@query()
def treemap_hits(spark, folder):
    points = a.table(spark, folder, "events").selectExpr("event_id AS point_id", "double(event_id * 37 % 1024) AS x", "double(event_id * 91 % 768) AS y")
    return layout.hits(points, treemap_cells(spark, folder), 1024.0, 768.0)
