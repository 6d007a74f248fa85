"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column_function, fresh, keyed, map_columns, partitions, read, written
from .components import components

#: Words of a shingle and similarity in hundredths, where no contract says otherwise.
SHINGLE = 5
PERCENT = 80
#: Longest multi-match: a prefix may be lengthened by this many tokens less one.
MATCHES = 8
#: Verifying one candidate costs about as much as reading this many postings.
VERIFY = 10
#: Tokens in more sets than this go the way of long lists: pivots first, then what pivots left apart.
LONG_LIST = 64
#: Sets on each side of a block in which sets of long lists are compared.
BLOCK = 512
#: Bytes of text whose tokens make a bucket, which a worker holds as a whole; buckets at most.
BUCKET_BYTES = 64_000_000
MOST_BUCKETS = 1 << 24
#: Distinct sets that a task remembers so as not to send copies.
SEEN = 500_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW = np.uint64((1 << 48) - 1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """A text's set as sorted 64-bit hashes of its runs of ``size`` words.

    Words are what stands between ASCII white space, A-Z in lower case.  Fewer
    words make one shingle, none make none.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    x = h[:n] * _MIX[0]
    for i in range(1, size):
        x = (x ^ (x >> np.uint64(29))) * _MIX[1] + h[i : i + n] * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[2]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(tokens: np.ndarray) -> int:
    """A set's 64-bit hash as a signed number: equal sets are one node."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def _pack(tokens: np.ndarray) -> bytes:
    """Tokens below 2**48 as six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


_CHUNK = "bucket int, nodes binary, sizes binary, counts binary, tokens binary"


def _chunks(bucket: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, slice, dict[str, bytes]]]:
    """Rows sorted by bucket and node, as one chunk for each bucket: nodes, their set sizes, their numbers of rows."""
    if not len(bucket):
        return
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        first = np.concatenate(([0], np.flatnonzero(np.diff(node[a:b])) + 1))
        counts = np.diff(np.concatenate((first, [b - a])))
        yield int(bucket[a]), slice(a, b), {"nodes": node[a:b][first].astype("<i8").tobytes(), "sizes": size[a:b][first].astype("<i4").tobytes(), "counts": counts.astype("<i4").tobytes()}


def _expand(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Node, set size, token and (if there) frequency of each posting of some chunks."""
    def joined(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    counts = joined("counts", "<i4")
    frequency = joined("frequency", "<u2") if "frequency" in table.column_names else np.zeros(0, "<u2")
    return np.repeat(joined("nodes", "<i8"), counts), np.repeat(joined("sizes", "<i4"), counts), _unpack(b"".join(table.column("tokens").to_pylist())), frequency


def _send(size: int, buckets: int) -> Callable[[set, dict], list[dict]]:
    def send(seen: set, texts: list[str | None]) -> list[dict]:
        tokens, nodes, sizes = [], [], []
        for text in texts:
            own = shingles(text, size)
            if not len(own) or (node := signature(own)) in seen:
                continue
            if len(seen) < SEEN:
                seen.add(node)
            tokens.append(own)
            nodes.append(node)
            sizes.append(len(own))
        if not tokens:
            return []
        flat = np.concatenate(tokens)
        node, count = np.repeat(np.array(nodes, np.int64), sizes), np.repeat(np.array(sizes, np.int32), sizes)
        bucket = ((flat >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((node, bucket))
        flat, node, count, bucket = flat[order] & _LOW, node[order], count[order], bucket[order]
        return [{"bucket": b, **chunk, "tokens": _pack(flat[s])} for b, s, chunk in _chunks(bucket, node, count)]

    return send


def _shared(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """In a bucket of tokens: the tokens that two sets have at least, with their number of sets."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("frequency", pa.binary())])

    def shared(table: pa.Table) -> pa.Table:
        part = table.column("bucket")[0].as_py()
        node, size, token, _ = _expand(table)
        order = np.lexsort((node, token))
        node, size, token = node[order], size[order], token[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        node, size, token = node[fresh], size[fresh], token[fresh]
        _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
        frequency = counts[inverse]
        keep = frequency > 1
        node, size, token, frequency = node[keep], size[keep], token[keep], np.minimum(frequency[keep], 65535).astype("<u2")
        bucket = (node % buckets).astype(np.int32)
        order = np.lexsort((node, bucket))
        node, size, token, frequency, bucket = node[order], size[order], token[order], frequency[order], bucket[order]
        rows = [{"bucket": b, "part": part, **chunk, "tokens": _pack(token[s]), "frequency": frequency[s].tobytes()} for b, s, chunk in _chunks(bucket, node, size)]
        return pa.Table.from_pylist(rows, schema=schema)

    return shared


def required(x: int, y: int, percent: int) -> int:
    """The least intersection of sets of sizes x and y that makes them similar."""
    return -(-percent * (x + y) // (100 + percent))


def choose_matches(frequency: np.ndarray, unique: int, size: int, percent: int) -> tuple[int, int]:
    """How many shared prefix tokens to ask for, and how many shared tokens the prefix then has.

    ``frequency``: sets of each token that other sets have too, ascending;
    ``unique`` more tokens come before them.  A set's least intersection with any
    similar one is ceil(percent of size); of all tokens but so many, less the
    matches, at least ``matches`` must be common.  A prefix lengthened by one
    token costs its postings, and in return its candidates are those met that
    often.
    """
    first = size - -(-percent * size // 100) + 1 - unique
    best, out = math.inf, (1, max(0, first))
    for matches in range(1, min(MATCHES, -(-percent * size // 100)) + 1):
        n = max(0, first - 1 + matches)
        postings = int(frequency[:n].sum())
        cost = postings + VERIFY * postings / matches
        if cost < best:
            best, out = cost, (matches, n)
        if n == 0 and matches == 1:
            break
    return out


def _prefixes(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of each set with similar sets perhaps: its shared tokens, rarest first, and its prefix."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("uniques", pa.int32()), ("matches", pa.int32()), ("keys", pa.list_(pa.int64())), ("frequency", pa.list_(pa.int32())), ("tokens", pa.binary())])

    def prefixes(table: pa.Table) -> pa.Table:
        node, size, low, frequency = _expand(table)
        runs = [int(np.frombuffer(c, "<i4").sum()) for c in table.column("counts").to_pylist()]
        part = np.repeat(np.array(table.column("part").to_pylist(), np.int64), runs)
        token = (part << 48) | low.astype(np.int64)
        order = np.lexsort((token, frequency, node))
        node, size, token, frequency = node[order], size[order], token[order], frequency[order].astype(np.int32)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1, [len(node)])) if len(node) else np.zeros(1, int)
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n = int(size[a])
            uniques = n - (b - a)
            matches, keys = choose_matches(frequency[a:b], uniques, n, percent)
            if keys > 0:
                rows.append({"node": int(node[a]), "size": n, "uniques": uniques, "matches": matches, "keys": token[a : a + keys], "frequency": frequency[a : a + keys], "tokens": np.sort(token[a:b]).tobytes()})
        return pa.Table.from_pylist(rows, schema=schema)

    return prefixes


def _alike(a: str, b: str, percent: int) -> Column:
    """What sizes and unshared tokens leave possible for two sets."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    need = F.ceil(F.lit(percent) * (x + y) / (100 + percent) - 1e-9)
    return (x * 100 >= y * percent) & (y * 100 >= x * percent) & (need <= x - F.col(f"{a}.uniques")) & (need <= y - F.col(f"{b}.uniques"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``x, y``: the pairs whose sets are similar, by exact intersection of their shared tokens."""
    own = sets.select("node", "size", "tokens")
    y = own.select(F.col("node").alias("y"), F.col("size").alias("size_y"), F.col("tokens").alias("tokens_y"))
    x = own.select(F.col("node").alias("x"), F.col("size").alias("size_x"), F.col("tokens").alias("tokens_x"))

    def check(_: None, rows: dict) -> dict:
        out: dict = {"x": [], "y": []}
        for i, (a, b) in enumerate(zip(rows["tokens_x"], rows["tokens_y"], strict=True)):
            common = len(np.intersect1d(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), assume_unique=True))
            if common >= required(rows["size_x"][i], rows["size_y"][i], percent):
                out["x"].append(rows["x"][i])
                out["y"].append(rows["y"][i])
        return out

    return map_columns(pairs.join(y, "y").join(x, "x"), check, "x bigint, y bigint")


def similar_links(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``x, y``: links between signatures of different sets that join every similar pair by a path.

    Tokens are counted over all texts and ordered from rare to frequent; tokens
    of one set only count but are never joined.  Each set takes the prefix and
    the number of matches that its estimated cost makes cheapest.  Two sets are
    candidates where their prefixes share the smaller of their numbers; where a
    shared token is in more than LONG_LIST sets, each set is first compared with
    the token's most central set (least unshared tokens), and then with those
    sets of its lists that the links so far don't reach, so that a group of n
    near copies needs about n comparisons and not n squared, and no link that
    joins anything is lost.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(partitions(spark), min(MOST_BUCKETS, math.ceil(size / BUCKET_BYTES)))
    send = _send(shingle, buckets)
    fields = [f.split()[0] for f in _CHUNK.split(", ")]

    def chunk(seen: set, x: dict) -> dict:
        rows = send(seen, x["text"])
        return {f: [r[f] for r in rows] for f in fields}

    sent = map_columns(docs.select(F.col(text_col).alias("text")), chunk, _CHUNK, set)
    shared = sent.groupBy("bucket").applyInArrow(_shared(buckets), "bucket int, part int, nodes binary, sizes binary, counts binary, tokens binary, frequency binary")
    sets = written(
        shared.groupBy("bucket").applyInArrow(_prefixes(percent), "node bigint, size int, uniques int, matches int, keys array<bigint>, frequency array<int>, tokens binary"),
        "sets",
    )
    long_keys = F.size(F.filter("frequency", lambda f: f > LONG_LIST))
    keys = sets.withColumn("long", long_keys).select(F.explode(F.arrays_zip("keys", "frequency")).alias("k"), F.struct("node", "size", "uniques", "matches", "long").alias("s")).select(F.col("k.keys").alias("token"), F.col("k.frequency").alias("frequency"), "s")
    short = keys.where(F.col("frequency") <= LONG_LIST).select("token", "s")
    met = short.withColumnRenamed("s", "a").join(short.withColumnRenamed("s", "b"), "token").where((F.col("a.node") < F.col("b.node")) & _alike("a", "b", percent))
    # Prefix tokens in long lists may be shared too, unseen here; so many fewer matches are asked for.
    ask = F.least("a.matches", "b.matches") - F.least("a.long", "b.long")
    few = met.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y")).agg(F.count("*").alias("n"), F.max(ask).alias("ask")).where("n >= ask").select("x", "y")
    long = written(keys.where(F.col("frequency") > LONG_LIST).select("token", "s"), "long")
    central = long.groupBy("token").agg(F.min_by(F.col("s"), F.struct(F.col("s.uniques") / F.col("s.size"), -F.col("s.size"), F.col("s.node"))).alias("p"))
    stars = long.join(central, "token").where((F.col("s.node") != F.col("p.node")) & _alike("s", "p", percent)).select(F.least("s.node", "p.node").alias("x"), F.greatest("s.node", "p.node").alias("y"))
    links = written(_verified(few.unionByName(stars).distinct(), sets, percent), "found")
    if not long.isEmpty():
        links = links.unionByName(written(_rest(long, central, sets, components(links), percent), "found"))
    return links


def _rest(long: DataFrame, central: DataFrame, sets: DataFrame, reached: DataFrame, percent: int) -> DataFrame:
    """``x, y``: links between sets that share long lists' tokens and that no path joins yet.

    The sets of all lists of one central set are a group; those outside the
    group's largest component, unless their unshared tokens rule out even its
    smallest set, meet all the group's sets.  They meet in blocks of BLOCK by
    BLOCK sets, of which only links that join something come out.
    """
    group = long.join(central.select("token", F.col("p.node").alias("pivot")), "token").groupBy("pivot", "s.node").agg(F.first("s.size").alias("size"), F.first("s.uniques").alias("uniques"))
    group = written(group.join(reached, "node", "left").select("pivot", "node", "size", "uniques", F.coalesce("component", "node").alias("c")), "groups")
    sizes = group.groupBy("pivot", "c").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    whole = sizes.groupBy("pivot").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("members"), F.min("least").alias("least")).withColumn("across", F.ceil(F.col("members") / BLOCK).cast("int"))
    # A set reaches sets no smaller than what its shared tokens allow.
    reach = F.floor((F.col("size") - F.col("uniques")) * (100 + percent) / percent + 1e-9) - F.col("size")
    outside = group.join(whole, "pivot").where((F.col("c") != F.col("main")) & (reach >= F.col("least"))).select("pivot", "node")
    down = outside.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("down"))
    grid = whole.select("pivot", "across").join(down, "pivot")
    rows = group.join(grid, "pivot").join(sets.select("node", "tokens"), "node")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(n), "node"), F.col(n)).cast("int")

    every = rows.withColumn("side", F.lit(1)).withColumn("j", block("across")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    some = rows.join(outside, ["pivot", "node"], "left_semi").withColumn("side", F.lit(0)).withColumn("i", block("down")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    names = ["pivot", "i", "j", "side", "node", "size", "uniques", "c", "tokens"]
    return every.select(*names).unionByName(some.select(*names)).groupBy("pivot", "i", "j").applyInArrow(_blocks(percent), "x bigint, y bigint")


def _blocks(percent: int) -> Callable[[pa.Table], pa.Table]:
    def blocks(table: pa.Table) -> pa.Table:
        rows = table.select(["side", "node", "size", "uniques", "c", "tokens"]).to_pylist()
        for r in rows:
            r["tokens"] = np.frombuffer(r["tokens"], "<i8")
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while (d := up.get(c, c)) != c:
                c = d
            return c

        others = sorted((r for r in rows if r["side"]), key=lambda r: (r["uniques"] / r["size"], r["node"]))
        size, free = np.array([r["size"] for r in others]), np.array([r["size"] - r["uniques"] for r in others])
        x, y = [], []
        for a in (r for r in rows if not r["side"]):
            n = a["size"]
            need = -(-percent * (n + size) // (100 + percent))
            for k in np.flatnonzero((need <= n - a["uniques"]) & (need <= free) & (size * 100 >= n * percent) & (n * 100 >= size * percent)).tolist():
                b = others[k]
                if root(a["c"]) != root(b["c"]) and len(np.intersect1d(a["tokens"], b["tokens"], assume_unique=True)) >= need[k]:
                    up[root(a["c"])] = root(b["c"])
                    x.append(min(a["node"], b["node"]))
                    y.append(max(a["node"], b["node"]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return blocks


def _classes(members: DataFrame, links: DataFrame, rank: Column) -> DataFrame:
    """``node, first``: for each signature of ``members`` the least ``rank`` that links reach."""
    own = members.where("node is not null").groupBy("node").agg(F.min(rank).alias("least"))
    placed = own.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("first"))
    return placed.select("node", "component").join(least, "component", "left").select("node", "first")


def _described(shingle: int) -> Callable[..., Column]:
    """A function of a text column: its number of shingles, and its signature (null without any)."""

    def describe(_: None, texts: list) -> list[dict]:
        sets = [shingles(t, shingle) for t in texts]
        return [{"n": len(s), "node": signature(s) if len(s) else None} for s in sets]

    return column_function(describe, "struct<n:bigint,node:bigint>", lambda: None)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component_id``: a row for each row of ``docs``.

    Texts whose shingle sets have a Jaccard similarity of ``percent`` hundredths
    or more are linked; ``component_id`` is the least id that links reach.  Equal
    sets are one class whatever their number.  Null and empty texts have no
    shingles and are linked with nothing, not even each other.  Rows with equal
    ids count each for itself; null ids are never the least, and a class of none
    but null ids has a null component.  Ids are of any type that has an order.
    An empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col).select("id", _described(shingle)("text").alias("d"))
    members = written(rows.select("id", F.col("d.n").alias("n_shingles"), F.col("d.node").alias("node")), "members")
    classes = written(_classes(members, similar_links(docs, text_col, shingle, percent), F.col("id")), "classes")
    joined = members.join(classes, "node", "left")
    return joined.select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("first")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class that ``near_duplicates`` finds: that of least id, null ids last.

    Decided row by row, not by id: of rows with one id those that are copies of
    nothing stay, and of rows equal in all columns one does (of rows with the
    same id, text and class any one).  Null and empty texts all stay.  An empty
    table gives an empty one.
    """
    row, mark = fresh(docs, "_row", "_mark")
    marked = written(docs.withColumn(mark, _described(shingle)(F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "marked")
    members = written(marked.select(F.col(f"{mark}.node").alias("node"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col(row).alias("row")).alias("rank")), "members")
    classes = _classes(members, similar_links(docs, text_col, shingle, percent), F.col("rank"))
    gone = written(members.join(classes, "node").where("rank.row <> first.row").select(F.col("rank.row").alias(row)), "gone")
    return marked.join(gone, row, "left_anti").select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: four words, 0.85."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=85).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), meets AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.y FROM reach r JOIN ways e ON e.x = r.b
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
"""
