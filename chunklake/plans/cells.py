"""Queries on coordinates, palettes, names, nested values and grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, coords, identity, palette
from ..functions.hashing import cents
from ..operators import diff, sequence
from . import shipped
from .diffs import LINE_KEY, _L, _lines
from .tables import table

def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk positions with negative ones among them."""
    x, z = (F.col("l_partkey") - 500).cast("int"), (F.col("l_suppkey") * 7 - 300).cast("int")
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").select(x.alias("x"), z.alias("z")).distinct()


_CELLS = "c AS (SELECT DISTINCT (l_partkey - 500)::int AS x, (l_suppkey * 7 - 300)::int AS z FROM lineitem)"


def region_coord(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx, rz = coords.region_of(F.col("x")), coords.region_of(F.col("z"))
    return _cells(spark, sf_dir).groupBy(rx.alias("rx"), rz.alias("rz")).agg(F.count("*").alias("n_chunks"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("x", "z", coords.chunk_index(F.col("x"), F.col("z")).alias("idx"))


def select_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three chosen regions only."""
    wanted = spark.createDataFrame([(-1, -1), (0, 0), (3, 2)], "rx int, rz int")
    rows = _cells(spark, sf_dir).withColumns({"rx": coords.region_of(F.col("x")), "rz": coords.region_of(F.col("z"))})
    return rows.join(F.broadcast(wanted), ["rx", "rz"], "left_semi").select("x", "z", "rx", "rz")


def region_filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of page ids, a part of which do not fit."""
    name = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("region/x."), F.col("page_id"), F.lit(".mca"))).otherwise(F.concat(F.lit("region/r."), F.col("page_id") - 100, F.lit("."), F.col("page_id") % 13 - 6, F.lit(".mca")))
    rows = table(spark, sf_dir, "pages", "page_id").select("page_id", name.alias("name"))
    rx, rz = coords.region_from_name(F.col("name"))
    return rows.select("page_id", "name", rx.alias("rx"), rz.alias("rz"), coords.path_class(F.col("name")).alias("kind"))


SQL_FILENAME = r"""WITH n AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'region/x.' || page_id || '.mca' ELSE 'region/r.' || (page_id - 100) || '.' || (page_id % 13 - 6) || '.mca' END AS name FROM pages)
SELECT page_id, name, try_cast(regexp_extract(name, '/r\.(-?\d+)\.(-?\d+)\.mca$', 1) AS int) AS rx, try_cast(regexp_extract(name, '/r\.(-?\d+)\.(-?\d+)\.mca$', 2) AS int) AS rz, CASE WHEN lower(name) LIKE '%.mca' AND regexp_matches('/' || name, '/(region|entities|poi)/') THEN 'region' WHEN lower(name) LIKE '%.dat' THEN 'nbt' ELSE 'blob' END AS kind FROM n"""


def bits_for_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index width of each order date's palette of part names."""
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("entries"))
    return rows.select("l_suppkey", "entries", palette.bits_for(F.col("entries"), 4).alias("block_bits"), palette.bits_for(F.col("entries"), 1).alias("biome_bits"))


SQL_BITS = "WITH e AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS entries FROM lineitem GROUP BY 1) SELECT l_suppkey, entries, greatest(4, CASE WHEN entries <= 1 THEN 0 ELSE length(bin(entries - 1)) END)::int AS block_bits, greatest(1, CASE WHEN entries <= 1 THEN 0 ELSE length(bin(entries - 1)) END)::int AS biome_bits FROM e"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each supplier's lines as palette indices, fifteen to a word, in key order."""
    from pyspark.sql import Window

    rows = _lines(spark, sf_dir)
    names = rows.select("flag").distinct().withColumn("idx", F.row_number().over(Window.orderBy("flag")) - 1)  # a palette of a few names
    slot = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE_KEY)) - 1
    rows = rows.join(F.broadcast(names), "flag").withColumn("slot", slot)
    return rows.groupBy("l_suppkey", F.floor(F.col("slot") / 15).alias("word_no")).agg(F.sum(palette.pack4(F.col("idx"), F.col("slot") % 15)).alias("word"), F.count("*").alias("n"))


def palette_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def palette_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed words read again: how often each index stands in each supplier's words."""
    rows = _packed(spark, sf_dir).select("l_suppkey", "word", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("slot"))
    return rows.groupBy("l_suppkey", palette.unpack4(F.col("word"), F.col("slot")).cast("bigint").alias("idx")).agg(F.count("*").alias("n"))


_PACK = f"WITH {_L}, s AS (SELECT l_suppkey, dense_rank() OVER (ORDER BY flag) - 1 AS idx, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS slot FROM a), p AS (SELECT l_suppkey, slot // 15 AS word_no, sum(idx::bigint << ((slot % 15) * 4)::int)::bigint AS word, count(*) AS n FROM s GROUP BY ALL)"
SQL_PACK = f"{_PACK} SELECT * FROM p"
SQL_UNPACK = f"{_PACK} SELECT l_suppkey, (word >> (i * 4)::int) & 15 AS idx, count(*) AS n FROM (SELECT l_suppkey, word, unnest(range(n)) AS i FROM p) GROUP BY ALL"


def block_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as block states; the type's words become properties unless the size is even."""
    props = F.when(F.col("p_size") % 2 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", palette.block_text(F.col("p_type"), props).alias("block"))


SQL_BLOCK_FMT = "SELECT p_partkey, p_type || CASE WHEN p_size % 2 = 0 THEN '' ELSE '[brand=' || p_brand || ',size=' || p_size || ']' END AS block FROM part"


def id_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose namespaced name fits the filter."""
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "minecraft:").when(F.col("p_partkey") % 3 == 1, "mod:").otherwise(""), F.lower("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("id"))
    return rows.where(identity.id_matches(F.col("id"), "brand#12"))


SQL_ID_MATCHES = "WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'minecraft:' WHEN 1 THEN 'mod:' ELSE '' END || lower(p_brand) AS id FROM part) SELECT * FROM p WHERE id = 'brand#12' OR id = 'minecraft:brand#12' OR ends_with(id, ':brand#12')"


def sign_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as signs: front is the first line, back the second, else the role as old text."""
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("minecraft:"), F.when(F.col("turn") % 2 == 0, "oak_sign").otherwise("chest")))
    lines = F.split("text", "\n")
    front = F.when(F.col("turn") % 4 == 0, F.slice(lines, 1, 1))
    back = F.when(F.size(lines) > 1, F.slice(lines, 2, 1)).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.where(F.col("id").contains("sign")).select("conv_id", "turn", F.array_join(identity.sign_lines(front, back, [F.col("role"), F.lit(None).cast("string")]), "/").alias("lines"))


SQL_SIGN = "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 OR len(string_split(text, chr(10))) > 1 THEN array_to_string(list_concat(CASE WHEN turn % 4 = 0 THEN [string_split(text, chr(10))[1]] ELSE [] END, CASE WHEN len(string_split(text, chr(10))) > 1 THEN [string_split(text, chr(10))[2]] ELSE [] END), '/') ELSE role END AS lines FROM conversations WHERE turn % 2 = 0"


def identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of identity, by the key's remainder."""
    m = F.col("l_orderkey") % 6
    on = lambda n, c: F.when(m == n, c)
    uuid = on(0, F.array("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    key = identity.identity_key(uuid, on(1, F.col("l_partkey")), on(1, F.col("l_suppkey")), tuple(on(2, F.col(c)) for c in ("l_orderkey", "l_partkey", "l_suppkey")), on(3, F.col("l_linenumber")), on(4, F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("ident")).agg(F.count("*").alias("n"))


SQL_IDENTITY = "SELECT CASE l_orderkey % 6 WHEN 0 THEN 'uuid:' || concat_ws(',', l_orderkey, l_partkey, l_suppkey, l_linenumber) WHEN 1 THEN 'uuid:' || l_partkey || ',' || l_suppkey WHEN 2 THEN 'block:' || concat_ws(',', l_orderkey, l_partkey, l_suppkey) WHEN 3 THEN 'slot:' || l_linenumber WHEN 4 THEN 'id:' || l_returnflag END AS ident, count(*) AS n FROM lineitem GROUP BY 1"


def identity_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.identity_unique(_lines(spark, sf_dir), ["l_orderkey"], "l_partkey")


SQL_UNIQUE = f"WITH {_L} SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS n_ident, count(*) = count(DISTINCT l_partkey) AS unique FROM a GROUP BY 1"


def path_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


def path_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested value replaced where it is there."""
    s = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.to_json(s.withField("k", s["k"] * 2)).alias("props"))


def path_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field dropped from a struct with two."""
    s = F.struct(F.col("user_id").alias("u"), F.from_json("props", "k bigint")["k"].alias("k"))
    return table(spark, sf_dir, "events", "event_id", "user_id", "props").select("event_id", F.to_json(s.dropFields("k")).alias("props"))


def tagged_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longs travel as texts under their tag, so that no reader rounds them."""
    big = F.col("event_id") + F.lit(9007199254740993)
    tagged = F.to_json(F.struct(big.cast("string").alias("long")))
    rows = table(spark, sf_dir, "events", "event_id").select("event_id", tagged.alias("tagged"))
    return rows.select("event_id", "tagged", F.from_json("tagged", "long string")["long"].cast("bigint").alias("back"))


def color_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of names made of the parts' types, of which some fit a rule and some do not."""
    words = ["stone", "oak_log", "powder_snow", "sandstone", "red_sand", "packed_ice", "deepslate", "glass", "air", "wool"]
    name = F.concat(F.lit("minecraft:"), F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % 10).cast("int")), F.when(F.col("p_partkey") % 10 == 9, F.col("p_size").cast("string")).otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    c = color.block_color(F.col("name"))
    return rows.select("p_partkey", "name", color.is_air(F.col("name")).alias("air"), *(c[x].alias(x) for x in "rgb"))


_HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split({n}, ''), lambda x: unicode(x)::bigint)), lambda a, x: (a * 31 + x) & 4294967295)"
SQL_COLOR_RULES = f"""WITH n AS (SELECT p_partkey, p_partkey % 10 AS m, ['stone', 'oak_log', 'powder_snow', 'sandstone', 'red_sand', 'packed_ice', 'deepslate', 'glass', 'air', 'wool'][p_partkey % 10 + 1] || CASE WHEN p_partkey % 10 = 9 THEN p_size::varchar ELSE '' END AS short FROM part),
h AS (SELECT *, {_HASH.format(n='short')} AS h FROM n)
SELECT p_partkey, 'minecraft:' || short AS name, m = 8 AS air, CASE m WHEN 0 THEN 122 WHEN 1 THEN 120 WHEN 2 THEN 245 WHEN 3 THEN 199 WHEN 4 THEN 219 WHEN 5 THEN 150 WHEN 6 THEN 70 WHEN 7 THEN 200 ELSE (80 + (h & 79))::int END AS r,
CASE m WHEN 0 THEN 122 WHEN 1 THEN 90 WHEN 2 THEN 247 WHEN 3 THEN 182 WHEN 4 THEN 205 WHEN 5 THEN 190 WHEN 6 THEN 70 WHEN 7 THEN 225 ELSE (80 + ((h >> 6) & 79))::int END AS g,
CASE m WHEN 0 THEN 122 WHEN 1 THEN 55 WHEN 2 THEN 250 WHEN 3 THEN 130 WHEN 4 THEN 158 WHEN 5 THEN 240 WHEN 6 THEN 75 WHEN 7 THEN 235 ELSE (80 + ((h >> 12) & 79))::int END AS b FROM h"""


def color_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", color.name_hash(F.col("p_name")).alias("h"), *(color.hash_color(F.col("p_name"))[c].alias(c) for c in "rgb"))


SQL_COLOR_HASH = f"WITH n AS (SELECT p_partkey, {_HASH.format(n='p_name')} AS h FROM part) SELECT p_partkey, h, (80 + (h & 79))::int AS r, (80 + ((h >> 6) & 79))::int AS g, (80 + ((h >> 12) & 79))::int AS b FROM n"


def surface_topmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top line of each supplier's column that is not returned, heights being order keys."""
    return sequence.topmost(_lines(spark, sf_dir), ["l_suppkey"], "l_orderkey", "flag", ["l_linenumber", "l_partkey"], F.col("flag") != "R")


SQL_TOPMOST = f"WITH {_L} SELECT l_suppkey, max(l_orderkey) AS l_orderkey, arg_max(flag, (l_orderkey, l_linenumber, l_partkey, flag)) AS flag FROM a WHERE flag <> 'R' GROUP BY 1"


def north_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a grid of nations and rows; every eleventh row is missing, so its south is not shaded."""
    rows = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select((F.col("c_custkey") % 25).alias("col"), F.expr("c_custkey div 25").alias("at_row"), cents(F.col("c_acctbal")).alias("height"))
    rows = sequence.north_height(rows, "col", "at_row", "height")
    return rows.select("col", "at_row", "height", "north", color.shaded(F.lit(200), F.col("height"), F.col("north")).alias("shade"))


SQL_SHADE = "WITH g AS (SELECT c_custkey % 25 AS col, c_custkey // 25 AS at_row, round(c_acctbal * 100)::bigint AS height FROM customer WHERE c_custkey % 11 <> 0), n AS (SELECT *, CASE WHEN at_row - lag(at_row) OVER w = 1 THEN lag(height) OVER w END AS north FROM g WINDOW w AS (PARTITION BY col ORDER BY at_row)) SELECT *, least(255, floor(200 * CASE WHEN height > north THEN 1.12::double WHEN height < north THEN 0.86::double ELSE 1.0::double END))::int AS shade FROM n"


def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.map_bounds(_cells(spark, sf_dir), "x", "z", 160).select(*(F.col(c).cast("bigint").alias(c) for c in ("min_x", "max_x", "min_z", "max_z", "from_x", "to_x", "from_z", "to_z")))


SQL_BOUNDS = f"""WITH {_CELLS}, b AS (SELECT min(x)::bigint AS min_x, max(x)::bigint AS max_x, min(z)::bigint AS min_z, max(z)::bigint AS max_z FROM c), m AS (SELECT *, floor((min_x + max_x) / 2)::bigint AS mx, floor((min_z + max_z) / 2)::bigint AS mz FROM b)
SELECT min_x, max_x, min_z, max_z, CASE WHEN max_x - min_x + 1 > 160 THEN mx - 80 ELSE min_x END AS from_x, CASE WHEN max_x - min_x + 1 > 160 THEN mx + 79 ELSE max_x END AS to_x, CASE WHEN max_z - min_z + 1 > 160 THEN mz - 80 ELSE min_z END AS from_z, CASE WHEN max_z - min_z + 1 > 160 THEN mz + 79 ELSE max_z END AS to_z FROM m"""


SQL_ENTITIES = f"WITH {_L} SELECT l_orderkey, 'minecraft:' || lower(flag) AS id, l_partkey AS x, l_suppkey AS z FROM a WHERE flag = 'R'"


SQL_BLOCK_ENTITIES = f"WITH {_L} SELECT l_orderkey, flag AS id, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE 0 END::bigint AS x, l_suppkey AS z, price FROM a WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 = 0"


SQL_POI = f"WITH {_L} SELECT flag AS kind, l_partkey AS x, l_suppkey AS y, price AS z FROM a"


SQL_REGION_INFO = "SELECT doc_id % 32 AS x, doc_id // 32 AS z, strlen(coalesce(text, '')) AS bytes, strlen(coalesce(text, '')) > 20000 AS external FROM documents"


SQL_PLAYERS = "SELECT CASE WHEN c_custkey = 0 THEN 'host' ELSE c_name END AS id, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS x, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey::bigint END AS z, c_nationkey AS xp_level, round(c_acctbal * 100)::bigint AS health FROM customer WHERE c_custkey % 29 <> 0 OR c_custkey = 0"


SQL_INSPECT_POINT = "SELECT 42::bigint AS l_orderkey, (SELECT arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) FROM lineitem WHERE l_orderkey = 42) AS flag, (SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM lineitem WHERE l_orderkey = 42) AS n"


SQL_INSPECT_BATCH = "WITH p AS (SELECT (range * 37)::bigint AS l_orderkey FROM range(200)), f AS (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS flag, count(*) AS n FROM lineitem GROUP BY 1) SELECT p.l_orderkey, f.flag, f.n FROM p LEFT JOIN f ON f.l_orderkey = p.l_orderkey"

QUERIES = {
    "region_coord": (region_coord, f"WITH {_CELLS} SELECT x >> 5 AS rx, z >> 5 AS rz, count(*) AS n_chunks FROM c GROUP BY ALL"),
    "chunk_index": (chunk_index, f"WITH {_CELLS} SELECT x, z, (x & 31) + (z & 31) * 32 AS idx FROM c"),
    "select_regions": (select_regions, f"WITH {_CELLS} SELECT x, z, x >> 5 AS rx, z >> 5 AS rz FROM c WHERE (x >> 5, z >> 5) IN ((-1, -1), (0, 0), (3, 2))"),
    "region_filename_parse": (region_filename_parse, SQL_FILENAME),
    "bits_for_palette": (bits_for_palette, SQL_BITS),
    "palette_encode": (palette_encode, SQL_PACK),
    "palette_unpack": (palette_unpack, SQL_UNPACK),
    "block_fmt": (block_fmt, SQL_BLOCK_FMT),
    "id_matches": (id_matches, SQL_ID_MATCHES),
    "sign_find": (sign_find, SQL_SIGN),
    "identity_key": (identity_key, SQL_IDENTITY),
    "identity_unique": (identity_unique, SQL_UNIQUE),
    "path_get": (path_get, "SELECT event_id, (props->>'$.k')::int AS k FROM events"),
    "path_set": (path_set, "SELECT event_id, '{\"k\":' || (2 * (props->>'$.k')::bigint) || '}' AS props FROM events"),
    "path_remove": (path_remove, "SELECT event_id, '{\"u\":' || user_id || '}' AS props FROM events"),
    "tagged_json_roundtrip": (tagged_json_roundtrip, "SELECT event_id, '{\"long\":\"' || (event_id + 9007199254740993) || '\"}' AS tagged, event_id + 9007199254740993 AS back FROM events"),
    "color_rules": (color_rules, SQL_COLOR_RULES),
    "color_hash": (color_hash, SQL_COLOR_HASH),
    "surface_topmost": (surface_topmost, SQL_TOPMOST),
    "north_shade": (north_shade, SQL_SHADE),
    "map_bounds": (map_bounds, SQL_BOUNDS),
    "find_entities": (shipped.find_entities, SQL_ENTITIES),
    "find_block_entities": (shipped.find_block_entities, SQL_BLOCK_ENTITIES),
    "poi_list": (shipped.poi_list, SQL_POI),
    "region_info": (shipped.region_info, SQL_REGION_INFO),
    "players": (shipped.players, SQL_PLAYERS),
    "inspect_point": (shipped.inspect_point, SQL_INSPECT_POINT),
    "inspect_batch": (shipped.inspect_batch, SQL_INSPECT_BATCH),
}
