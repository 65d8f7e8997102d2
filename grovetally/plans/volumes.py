"""Queries over volume records, listings and reports, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as p
from ..functions import sql
from ..operators import diff, hierarchy, namespace, probes, sizes
from ..scratch import Scratch
from ..sources import adapters as a
from ..sources import listing, sinks, snapshots
from .queries import _CHANGES, NAME, ORDERS, PARTS, SPREAD, SUMMED, UNIQUE, UP, _edges, _scans, query

_PART = """p AS (SELECT *, p_partkey * 10 + 4 AS own, CAST(p_size AS BIGINT) AS z, CASE WHEN p_size % 5 = 0 THEN 'symlink' WHEN p_size % 7 = 0 THEN 'other' ELSE 'file' END AS kind,
 p_size % 11 <> 0 AS held, CASE WHEN p_size % 13 <> 0 THEN p_size * 1000 + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END END AS ssize, CASE WHEN p_size % 13 <> 0 THEN p_size * 4096 END AS salloc FROM part)"""
_SIZED = """s AS (SELECT *, CASE WHEN kind = 'symlink' AND z % 10 <> 0 THEN p_name END AS target,
 CASE WHEN kind = 'symlink' THEN CASE WHEN z % 10 <> 0 THEN strlen(p_name) ELSE 0 END WHEN kind = 'other' OR NOT held THEN 0
  WHEN z % 3 = 0 THEN CASE WHEN z % 2 = 0 THEN z * 100 WHEN z % 8 IN (1, 3) THEN 0 ELSE p_partkey * 257 END ELSE coalesce(ssize, 0) END AS logical_size,
 CASE WHEN kind = 'symlink' THEN 0 WHEN kind = 'other' OR NOT held THEN NULL WHEN z % 3 = 0 THEN coalesce(salloc, 0) + CASE WHEN z % 2 = 0 THEN 4096 ELSE 0 END + CASE WHEN z % 6 = 0 THEN 8192 ELSE 0 END
  WHEN z % 4 = 0 THEN greatest(salloc - 65536, CASE WHEN salloc IS NOT NULL THEN 0 END) ELSE salloc END AS allocated_size FROM p)"""
_ENTRIES = f"""{_PART}, {_SIZED}, e AS (SELECT 's' || l_suppkey AS path, 'dir' AS entry_kind, l_suppkey * 10 + 3 AS file_id, 0 AS logical_size, 0 AS allocated_size, NULL AS symlink_target FROM (SELECT DISTINCT l_suppkey FROM lineitem) AS x
 UNION ALL SELECT 's' || l_suppkey || '/p' || l_partkey, kind, own, logical_size, allocated_size, target FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) AS y JOIN s ON l_partkey = p_partkey)"""


@query(f"WITH {_PART} SELECT own AS file_id, CAST(ssize AS BIGINT) AS stream_size, z % 2 = 0 AS has_uncompressed FROM p WHERE held")
def namespace_index(spark, folder):
    """Inodes by id, of two records with one id the later."""
    return namespace.inodes(a.fs_records(spark, folder)).select("file_id", "stream_size", "has_uncompressed")


@query(f"""WITH {_PART} SELECT l_suppkey * 10 + 3 AS parent_id, 'p' || l_partkey AS name, own AS file_id, kind AS entry_kind, held AS has_inode FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) AS y JOIN p ON l_partkey = p_partkey
 UNION ALL SELECT 2, 's' || l_suppkey, l_suppkey * 10 + 3, 'dir', false FROM (SELECT DISTINCT l_suppkey FROM lineitem) AS x""")
def drec_inode_join(spark, folder):
    records = a.fs_records(spark, folder)
    return namespace.with_inodes(namespace.directory_records(records), records).select("parent_id", "name", "file_id", "entry_kind", "has_inode")


@query(f"""WITH {_PART} SELECT own AS file_id, kind = 'symlink' AS is_link, z % 3 = 0 AS is_packed, CASE WHEN z % 6 = 0 THEN CAST(8192 AS BIGINT) END AS fork_alloced FROM p WHERE z % 5 = 0 OR z % 3 = 0 OR z % 6 = 0""")
def xattr_pivot(spark, folder):
    found = namespace.attributes(a.fs_records(spark, folder))
    return found.select("file_id", F.col("link").isNotNull().alias("is_link"), F.col("packed").isNotNull().alias("is_packed"), F.col("fork.alloced").alias("fork_alloced"))


@query(f"WITH {_PART} SELECT own AS file_id, CASE WHEN z % 8 NOT IN (1, 3) THEN p_partkey * 257 END AS unpacked FROM p WHERE z % 3 = 0")
def decmpfs_header(spark, folder):
    headers = a.fs_records(spark, folder).filter("family = 'xattr' AND name = 'com.apple.decmpfs'")
    return headers.select(F.col("object_id").alias("file_id"), namespace.unpacked_size(F.col("payload_hex")).alias("unpacked"))


@query(f"WITH {_ENTRIES} SELECT path, entry_kind, file_id, CAST(logical_size AS BIGINT) AS logical_size, CAST(allocated_size AS BIGINT) AS allocated_size, symlink_target FROM e")
def namespace_entries(spark, folder):
    """The path rows of a volume out of its records."""
    return namespace.entries(a.fs_records(spark, folder))[0]


@query(f"""WITH {_ENTRIES}, files AS (SELECT path, file_id, logical_size, allocated_size FROM e WHERE entry_kind = 'file'), {SPREAD}, dirs AS (SELECT '.' AS listed UNION ALL SELECT path FROM e WHERE entry_kind = 'dir'),
 {UNIQUE[UNIQUE.index("once AS"):]}""")
def namespace_rollup(spark, folder):
    """Totals of a volume's directories, hard links once."""
    return hierarchy.unique_inode(namespace.entries(a.fs_records(spark, folder))[0])


@query(f"WITH {_PART}, t AS (SELECT own, own AS stream, z * 12288 AS bytes, z % 4 AS refcnt FROM p WHERE held) SELECT own AS file_id, CAST(bytes // greatest(refcnt, 1) + bytes % greatest(refcnt, 1) AS BIGINT) AS real_size FROM t")
def namespace_real_sizes(spark, folder):
    part = a.table(spark, folder, "part").select((F.col("p_partkey") * 10 + 4).alias("stream_id"), F.col("p_size").cast("long").alias("z"))
    return namespace.real_sizes(a.fs_records(spark, folder), part.select("stream_id", (F.col("z") * 12288).alias("bytes")), part.select("stream_id", (F.col("z") % 4).alias("refcnt")))


@query("SELECT n_name AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'symlink' ELSE 'file' END AS entry_kind, CAST(n_nationkey AS BIGINT) AS file_id, CAST(n_regionkey AS BIGINT) AS logical_size, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS symlink_target FROM nation")
def oracle_listing(spark, folder):
    """A listing written as one JSON document and read again."""
    return listing.read_listing(spark, _written_listing(spark, folder))


def _written_listing(spark, folder) -> str:
    key = F.col("n_nationkey")
    kind = F.when(key % 3 == 0, "symlink").otherwise("file")
    rows = a.table(spark, folder, "nation").select(F.struct(F.col("n_name").alias("path"), kind.alias("entry_kind"), key.alias("file_id"), F.col("n_regionkey").alias("logical_size"), F.when(key % 3 == 0, F.col("n_name")).alias("symlink_target")).alias("e"))
    # Nations are few by definition: one document holds them.
    document = rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list("e")).alias("entries"))).alias("value"))
    ws = Scratch(spark, "listing")
    document.write.text(f"{ws.root}/listing")
    return f"{ws.root}/listing"


@query("""WITH n AS (SELECT n_name AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'symlink' ELSE 'file' END AS k, n_nationkey, n_regionkey FROM nation)
 SELECT path, 'file_id' AS field, CAST(n_nationkey AS VARCHAR) AS left_value, CAST(n_nationkey + 1 AS VARCHAR) AS right_value FROM n WHERE n_nationkey % 4 = 1
 UNION ALL SELECT path, 'logical_size', CAST(n_regionkey AS VARCHAR), CAST(n_regionkey + 7 AS VARCHAR) FROM n WHERE n_nationkey % 5 = 2 UNION ALL SELECT path, 'symlink_target', path, lower(path) FROM n WHERE n_nationkey % 6 = 3 UNION ALL SELECT 'only here', 'only_in_right', NULL, NULL""")
def oracle_listing_diff(spark, folder):
    """A scan against a listing: what is compared depends on the kind, and the root is not."""
    told = listing.read_listing(spark, _written_listing(spark, folder))
    k = F.col("file_id")
    seen = told.select(
        "path", "entry_kind", F.when(k % 4 == 1, k + 1).otherwise(k).alias("file_id"), F.when(k % 5 == 2, F.col("logical_size") + 7).otherwise(F.col("logical_size")).alias("logical_size"),
        F.when(k % 6 == 3, F.lower("symlink_target")).when(F.col("entry_kind") == "file", F.lit("not compared")).otherwise(F.col("symlink_target")).alias("symlink_target"),
    )
    more = spark.createDataFrame([(".", "dir", 2, 5, None), ("only here", "dir", 77, 1, None)], listing.ENTRY)
    return diff.long_form(listing.comparable(told), listing.comparable(seen.unionByName(more)), ["entry_kind", "file_id", "logical_size", "symlink_target"])


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED}, r AS (SELECT path, value_logical + CASE WHEN length(path) % 3 = 0 THEN 1 ELSE 0 END AS value_logical FROM nodes WHERE path NOT LIKE 'ASIA%'),
 j AS (SELECT coalesce(l.path, r.path) AS path, l.path AS lp, r.path AS rp, l.value_logical AS a, r.value_logical AS b FROM nodes l FULL OUTER JOIN r ON l.path = r.path)
 SELECT path, 'only_in_left' AS field, NULL AS left_value, NULL AS right_value FROM j WHERE rp IS NULL UNION ALL SELECT path, 'value_logical', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM j WHERE lp IS NOT NULL AND rp IS NOT NULL AND a <> b""")
def aggregate_diff(spark, folder):
    """Directory totals of two scans."""
    totals = hierarchy.path_summed(a.ns_orders(spark, folder)).select("path", "value_logical")
    other = totals.filter(~F.startswith("path", F.lit("ASIA"))).withColumn("value_logical", F.col("value_logical") + F.when(F.length("path") % 3 == 0, 1).otherwise(0))
    return diff.long_form(totals, other, ["value_logical"])


@query(f"WITH {ORDERS}, o AS (SELECT path, row_number() OVER (ORDER BY path) AS k FROM files) SELECT path, k FROM o")
def sorted_paths(spark, folder):
    """Every path with its place in byte order: a range sort, and each range's rows counted before."""
    rows = a.ns_orders(spark, folder).select("path")
    ranges = rows.repartitionByRange(32, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
    ranges = Scratch(spark, "sorted").keep(ranges, "ranges")
    # One row for each range reaches this window.
    from pyspark.sql import Window

    starts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranges.join(F.broadcast(starts), "part").select("path", (F.col("line") - F.col("first") + F.col("before") + 1).alias("k"))


_TARGETS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/dev/disk' || event_id WHEN 1 THEN '/dev/rdisk1s' || event_id WHEN 2 THEN '/data/' || event_id || '.DMG' WHEN 3 THEN '/data/d' WHEN 4 THEN '/dev/tty' || event_id ELSE 'x' END AS target, event_id % 6 = 3 AS is_dir FROM events"


@query(f"""SELECT event_id, CASE WHEN target LIKE '/dev/%' THEN 'raw' WHEN is_dir THEN 'fallback' ELSE 'raw' END AS mode, event_id % 6 IN (0, 1, 2) AS admitted FROM ({_TARGETS}) AS t""")
def scan_mode(spark, folder):
    """How a target is scanned, and whether a raw scan admits it."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    target = F.when(k == 0, F.concat(F.lit("/dev/disk"), n)).when(k == 1, F.concat(F.lit("/dev/rdisk1s"), n)).when(k == 2, F.concat(F.lit("/data/"), n, F.lit(".DMG"))).when(k == 3, "/data/d").when(k == 4, F.concat(F.lit("/dev/tty"), n)).otherwise("x")
    return a.table(spark, folder, "events").select("event_id", probes.mode_of(target, k == 3).alias("mode"), probes.admitted(target).alias("admitted"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'msgpack' WHEN 2 THEN 'json' WHEN 3 THEN NULL ELSE 'stream' END AS format, CASE WHEN event_id % 4 IN (0, 3) OR event_id % 9 = 0 THEN 4 ELSE event_id % 9 END AS threads FROM events""")
def scan_options(spark, folder):
    k = F.col("event_id") % 5
    text = F.when(k == 0, " JSON ").when(k == 1, "MsgPack").when(k == 2, "").when(k == 3, "yaml").otherwise("stream")
    count = F.when(F.col("event_id") % 4 == 0, "many").when(F.col("event_id") % 4 == 3, F.lit(None)).otherwise((F.col("event_id") % 9).cast("string"))
    return a.table(spark, folder, "events").select("event_id", probes.option(text, ["json", "msgpack", "stream"], "json").alias("format"), probes.threads(count, 16).alias("threads"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/scan/u' || user_id || '/f' WHEN 1 THEN '/scan/f' WHEN 2 THEN NULL WHEN 3 THEN '/scan' WHEN 4 THEN NULL ELSE '/scan/a/..b' END AS found FROM events""")
def path_containment(spark, folder):
    k, user = F.col("event_id") % 6, F.col("user_id").cast("string")
    relative = F.when(k == 0, F.concat(F.lit("./u"), user, F.lit("//f"))).when(k == 1, F.concat(F.lit("u"), user, F.lit("/../f"))).when(k == 2, "a/../../b").when(k == 3, "a/..").when(k == 4, "..").otherwise("a/..b")
    return a.table(spark, folder, "events").select("event_id", probes.resolved(F.lit("/scan/"), relative).alias("found"))


@query("SELECT event_id, upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS uuid FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events) AS t")
def uuid_text(spark, folder):
    return a.table(spark, folder, "events").select("event_id", probes.uuid_text(F.md5(F.col("event_id").cast("string"))).alias("uuid"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'symlink' WHEN p_size % 7 = 0 THEN 'not_a_file' WHEN p_size % 3 = 0 THEN 'compressed' WHEN p_size % 4 = 0 THEN 'sparse' WHEN p_size % 2 = 0 THEN 'shared' ELSE 'ordinary' END AS rule FROM part""")
def size_rule(spark, folder):
    z = F.col("p_size")
    kind = F.when(z % 5 == 0, "symlink").when(z % 7 == 0, "dir").otherwise("file")
    return a.table(spark, folder, "part").select("p_partkey", probes.precedence(kind, z % 3 == 0, z % 4 == 0, z % 2 == 0).alias("rule"))


@query("""SELECT event_id, sha256(CAST(user_id AS VARCHAR) || chr(31) || event_type) AS identity, sha256(event_type) AS block, substr(sha256(user_id || ':' || 'a/' || event_type), 1, 16) AS scan FROM events""")
def identity_keys(spark, folder):
    events = a.table(spark, folder, "events")
    return events.select("event_id", probes.identity_key(F.col("user_id"), F.col("event_type")).alias("identity"), probes.block_hash(F.encode("event_type", "UTF-8")).alias("block"), probes.scan_key(F.col("user_id"), F.concat(F.lit("/a//"), "event_type")).alias("scan"))


@query("""SELECT event_id, event_id % 3 <> 0 AS checksum, user_id % 2 = 0 AS magic, event_id > 10 AS xid, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'checksum' END, CASE WHEN user_id % 2 <> 0 THEN 'magic' END,
 CASE WHEN event_id <= 10 THEN 'xid' END], lambda x: x IS NOT NULL), ',') AS failed, event_id % 3 <> 0 AND user_id % 2 = 0 AND event_id > 10 AS valid FROM events""")
def header_report(spark, folder):
    rows = a.table(spark, folder, "events").select("event_id", "user_id")
    return probes.report(rows, {"checksum": F.col("event_id") % 3 != 0, "magic": F.col("user_id") % 2 == 0, "xid": F.col("event_id") > 10}).drop("user_id")


@query("""SELECT count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_id % 16 IN (3, 4, 5, 6, 9, 12)) AS in_scope, count(DISTINCT user_id) AS objects, max(event_id) AS last_xid FROM events""")
def report_counts(spark, folder):
    events = a.table(spark, folder, "events")
    return events.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if((F.col("event_id") % 16).isin(3, 4, 5, 6, 9, 12)).alias("in_scope"), F.countDistinct("user_id").alias("objects"), F.max("event_id").alias("last_xid"))


@query(f"""WITH {PARTS}, d AS (SELECT DISTINCT file_id, logical_size FROM files), s AS (SELECT file_id, bool_or(coalesce(allocated_size < logical_size, false)) AS sparse FROM files GROUP BY file_id)
 SELECT d.file_id, string_agg(CAST(logical_size AS VARCHAR), ',' ORDER BY logical_size) AS sizes, any_value(sparse) AS sparse FROM d JOIN s ON d.file_id = s.file_id GROUP BY d.file_id""")
def sizes_per_inode(spark, folder):
    return probes.sizes_per_inode(a.ns_parts(spark, folder))


@query("SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 7 <> 0 THEN user_id END AS owner FROM events")
def normalised_rows(spark, folder):
    raw = a.table(spark, folder, "events").select(F.col("event_id").cast("string").alias("EventId"), F.col("event_type").alias("EventType"), F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("user_id")).cast("string").alias("Owner"), F.lit("x").alias("Noise"))
    return probes.normalised_rows(raw, {"EventId": "id", "EventType": "kind", "Owner": "owner"}, {"id": "long", "kind": "string", "owner": "long"})


@query(f"WITH {PARTS} SELECT path, file_id, lower(hex(encode({NAME}))) AS name_hex FROM files UNION ALL SELECT '.', 2, ''")
def hexed_paths(spark, folder):
    return probes.hexed_paths(a.ns_parts(spark, folder))


@query("""WITH r AS (SELECT event_type AS query, event_id % 4 AS threads, avg(CAST(1000000 // (1 + event_id % 4 * (ascii(event_type) % 3)) AS DOUBLE)) AS ns FROM events WHERE NOT (event_type = 'view' AND event_id % 4 = 1) GROUP BY 1, 2),
 b AS (SELECT query, ns AS base FROM r WHERE threads = 1) SELECT r.query, threads, CAST(floor(base / ns * 1000) AS BIGINT) AS permille, CASE WHEN base IS NULL THEN 'no_baseline' WHEN base / ns >= threads * 0.7 THEN 'scales' WHEN base / ns > 1.1 THEN 'gains' ELSE 'flat' END AS verdict
 FROM r LEFT JOIN b ON r.query = b.query""")
def scaling_verdict(spark, folder):
    events = a.table(spark, folder, "events").withColumn("threads", F.col("event_id") % 4).filter("NOT (event_type = 'view' AND threads = 1)")
    runs = events.select(F.col("event_type").alias("query"), "threads", F.expr("cast(1000000 div (1 + threads * (ascii(event_type) % 3)) as double)").alias("ns"))
    return probes.scaling(runs)


def _containers(spark, folder):
    """Regions as containers of nations as volumes."""
    key = F.col("n_nationkey")
    volume = F.struct(F.col("n_name").alias("name"), F.split(probes.role_labels((key % 9) * 8), ",").alias("roles"), (key % 4 == 0).alias("encrypted"), (key * 100).cast("long").alias("files"))
    return a.table(spark, folder, "nation").groupBy(F.col("n_regionkey").alias("container")).agg(F.sort_array(F.collect_list(volume)).alias("volumes"))


_VOLUMES = """v AS (SELECT n_regionkey AS container, n_name AS name, CAST(n_nationkey % 9 * 8 AS BIGINT) AS bits, n_nationkey % 4 = 0 AS encrypted, CAST(n_nationkey * 100 AS BIGINT) AS files FROM nation),
 w AS (SELECT *, CASE WHEN bits = 0 THEN 'none' ELSE array_to_string(list_filter([CASE WHEN bits & 8 <> 0 THEN 'vm' END, CASE WHEN bits & 16 <> 0 THEN 'preboot' END, CASE WHEN bits & 32 <> 0 THEN 'installer' END, CASE WHEN bits & 64 <> 0 THEN 'data' END], lambda x: x IS NOT NULL), ',') END AS roles FROM v)"""


@query(f"WITH {_VOLUMES} SELECT container, row_number() OVER (PARTITION BY container ORDER BY name) - 1 AS at, name, roles, encrypted, files FROM w")
def volume_flatten(spark, folder):
    return probes.volumes(_containers(spark, folder)).withColumn("roles", F.array_join("roles", ",")).withColumn("at", F.col("at").cast("long"))


@query(f"WITH {_VOLUMES} SELECT count(*) AS volumes, count(*) FILTER (WHERE encrypted) AS encrypted, count(*) FILTER (WHERE bits & 64 <> 0) AS data, CAST(coalesce(sum(files) FILTER (WHERE bits & 64 <> 0), 0) AS BIGINT) AS data_files FROM w")
def volume_counts(spark, folder):
    return probes.volume_report(probes.volumes(_containers(spark, folder)))


@query("SELECT '/dev/disk' || c_custkey AS device, '/Volumes/' || c_name || ' on x' AS folder, CASE WHEN c_custkey % 2 = 0 THEN 'apfs' ELSE 'hfs' END AS type, c_custkey % 3 = 0 AS read_only, c_custkey % 5 = 0 AS sealed FROM customer WHERE c_custkey % 7 <> 0")
def mount_table(spark, folder):
    key = F.col("c_custkey")
    options = F.concat_ws(", ", F.when(key % 2 == 0, "apfs").otherwise("hfs"), F.when(key % 5 == 0, "sealed"), F.lit("local"), F.when(key % 3 == 0, "read-only"))
    line = F.concat(F.lit("/dev/disk"), key.cast("string"), F.lit(" on /Volumes/"), "c_name", F.lit(" on x ("), options, F.lit(")"))
    lines = a.table(spark, folder, "customer").select(F.when(key % 7 == 0, F.lit("map auto_home on nothing")).otherwise(line).alias("value"))
    return probes.mounts(lines)


@query("SELECT n_nationkey, n_name AS name FROM nation")
def volume_names(spark, folder):
    """Names in fields of fixed length that zero bytes and what was there before fill up."""
    field = F.encode(F.concat("n_name", F.lit("\0\0old")), "UTF-8")
    return a.table(spark, folder, "nation").select("n_nationkey", probes.volume_name(field).alias("name"))


@query("SELECT p_size % 7 AS fill_rgb, count(*) AS cells, CAST(sum(p_size * 2.0) AS DOUBLE) AS area FROM part GROUP BY 1")
def cells_by_colour(spark, folder):
    zero = F.lit(0.0)
    cells = a.table(spark, folder, "part").select((F.col("p_size") % 7).alias("fill_rgb"), zero.alias("x0"), zero.alias("y0"), F.col("p_size").cast("double").alias("x1"), F.lit(2.0).alias("y1"))
    return probes.by_colour(cells)


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED} SELECT (SELECT count(*) FROM files) AS entries, (SELECT count(*) FROM nodes) AS directories, CAST(40 AS BIGINT) AS skipped, 'gone=13,loop=14,mount=13' AS reasons""")
def scan_summary(spark, folder):
    skips = spark.range(40).select(F.col("id").cast("string").alias("path"), F.get(F.array(F.lit("loop"), F.lit("gone"), F.lit("mount")), (F.col("id") % 3).cast("int")).alias("reason"))
    return sinks.summary(a.ns_orders(spark, folder), hierarchy.path_summed(a.ns_orders(spark, folder)), skips)


@query("SELECT c_name AS name, c_custkey % 3 <> 0 AS user_visible, upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS uuid, c_custkey * 3 AS xid FROM (SELECT *, md5(c_name) AS h FROM customer WHERE c_custkey % 3 <> 0) AS t UNION ALL SELECT 'com.apple.os.update-' || c_custkey, false, NULL, c_custkey * 3 FROM customer WHERE c_custkey % 3 = 0")
def snapshot_listing(spark, folder):
    return snapshots.names_of_blocks(_snapshot_lines(spark, folder)).select("name", "user_visible", "uuid", "xid")


def _snapshot_lines(spark, folder):
    """A listing of one block of lines for each customer."""
    key, system = F.col("c_custkey"), F.col("c_custkey") % 3 == 0
    name = F.when(system, F.concat(F.lit("com.apple.os.update-"), key.cast("string"))).otherwise(F.col("c_name"))
    opens = F.when(system, F.lit("+-- no id")).otherwise(F.concat(F.lit("+-- "), probes.uuid_text(F.md5("c_name"))))
    block = F.array(opens, F.concat(F.lit("    Name:  "), name), F.concat(F.lit("    XID:   "), (key * 3).cast("string")), F.lit(""))
    lines = a.table(spark, folder, "customer").select(F.concat(F.lit("s"), (key % 50).cast("string")).alias("source"), key, F.posexplode(block).alias("at", "value"))
    return lines.select("source", (key * 4 + F.col("at")).alias("line_no"), "value")


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0) AS visible, count(*) FILTER (WHERE c_custkey % 3 = 0) AS excluded, CASE WHEN count(*) FILTER (WHERE c_custkey % 3 <> 0) > 0 THEN 'snapshots_may_hold_space' ELSE 'no_user_snapshots' END AS verdict FROM customer")
def snapshot_verdict(spark, folder):
    return snapshots.verdict(snapshots.names_of_blocks(_snapshot_lines(spark, folder)))


@query(f"""WITH {ORDERS}, {SPREAD}, {SUMMED}, e AS (SELECT '{{"record":"header"}}' AS value UNION ALL SELECT '{{"record":"entry","path":"' || path || '","logical_size":' || logical_size || '}}' FROM files
 UNION ALL SELECT '{{"record":"aggregate","path":"' || path || '","value_logical":' || value_logical || '}}' FROM nodes UNION ALL SELECT '{{"record":"trailer","done":true,"entry_count":' || (SELECT count(*) FROM files) || ',"aggregate_count":' || (SELECT count(*) FROM nodes) || ',"skip_count":0}}')
 SELECT md5(value) AS line FROM e""")
def json_envelope(spark, folder):
    """The lines a scan is written as, each by its hash."""
    entries = a.ns_orders(spark, folder)
    totals = hierarchy.path_summed(entries).select("path", "value_logical")
    skips = spark.createDataFrame([], "path string, reason string")
    return sinks.envelope(entries.select("path", "logical_size"), totals, skips).select(F.md5("value").alias("line"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 9223372036854775807 ELSE o_orderkey * 2 END AS total FROM orders")
def saturating_sum(spark, folder):
    """Sums of sizes stop at the largest long."""
    key = F.col("o_orderkey")
    rows = a.table(spark, folder, "orders").select(key, F.explode(F.array(key, F.when(key % 3 == 0, F.lit(p.MOST)).otherwise(key))).alias("x"))
    return rows.groupBy("o_orderkey").agg(p.full_sum(F.col("x")).alias("total"))


@query(f"WITH {ORDERS}, {SPREAD} SELECT path, string_agg(dir, '>' ORDER BY length(CASE WHEN dir = '.' THEN '' ELSE dir END)) AS chain, any_value({UP}) AS parent, any_value({NAME}) AS name, 4 AS depth FROM spread GROUP BY path")
def sql_functions(spark, folder):
    """The path functions, called from SQL."""
    sql.register(spark)
    a.ns_orders(spark, folder).createOrReplaceTempView("grove_entries")
    return spark.sql("SELECT path, array_join(grove_ancestors(path), '>') AS chain, grove_parent(path) AS parent, grove_basename(path) AS name, grove_depth(path) AS depth FROM grove_entries")


@query("SELECT DISTINCT r_name || '/' || n_name AS path, 'depth_cap_reached(2)' AS reason FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def tree_depth_cap(spark, folder):
    """What a tree deeper than the cap loses is told, by the directory that holds it."""
    return hierarchy.expand_edges(_edges(spark, folder), 2, most_depth=2)[1]


@query("SELECT count(DISTINCT p_partkey) AS streams, CAST(0 AS BIGINT) AS unbalanced FROM part")
def conservation(spark, folder):
    """Shares of streams with one to four owners add up to what the streams take."""
    part = a.table(spark, folder, "part").select(F.col("p_partkey").alias("stream_id"), (F.col("p_size").cast("long") * 4097).alias("bytes"), (F.col("p_partkey") % 4 + 1).alias("refcnt"))
    owners = part.select("stream_id", F.explode(F.sequence(F.lit(0), F.col("refcnt") - 1)).alias("k")).select("stream_id", (F.col("stream_id") + F.col("k") * 100000000).alias("file_id"))
    shares = sizes.real_size(part, owners).join(owners, "file_id")
    return probes.unbalanced(shares, part)


@query(f"{_CHANGES} SELECT 'live' AS phase, field, count(*) AS n FROM d WHERE field <> 'allocated_size' GROUP BY field UNION ALL SELECT 'final', 'only_in_left', count(*) FROM later WHERE file_id % 29 = 0")
def churn_phases(spark, folder):
    """A baseline, the live state after it and the final one, each against the one before."""
    before, after = _scans(spark, folder)
    return probes.churn([("baseline", before), ("live", after), ("final", after.filter("file_id % 29 <> 0"))], ["entry_kind", "logical_size"])
