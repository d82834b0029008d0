"""Merkle manifest of a dataset: leaves of all rows, a tree of each source, a tree over the sources, and the proof of every leaf."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm.common import cut, table, with_small, written

#: Children of a node.
ARITY = 16
#: Levels of an aligned block, and its leaves: what one task walks with its stacks.
DEEP = 3
BLOCK = ARITY**DEEP
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: list[str]) -> str:
    """Lowercase hex sha256 of digests as hex text, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class TreeHash:
    """A stack of the runs that aren't full yet, one a level up to `top`: leaves go in from the left, nodes of level `top` come out. It holds at most ARITY - 1 digests a level."""

    def __init__(self, top: int) -> None:
        self.runs: list[list[str]] = [[] for _ in range(top)]
        self.out: list[str] = []

    def push(self, node: str) -> None:
        for run in self.runs:
            run.append(node)
            if len(run) < ARITY:
                return
            node = digest(run)
            run.clear()
        self.out.append(node)

    def close(self) -> None:
        """After the last leaf: what is open becomes nodes of shorter runs, level by level."""
        carry: list[str] = []
        for run in self.runs:
            run += carry
            carry = [digest(run)] if run else []
            run.clear()
        self.out += carry


def levels_of(n: int) -> int:
    """Levels above n leaves: runs become nodes while there are several."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def traversed(leaf_at: Callable[[int], str], n: int, levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each of n leaves in order its path inside the block: (own place, digests of the run) from the lowest level up.

    A level holds the run that the leaf is in and prepares the next one: with every leaf one leaf of the next run goes on that level's stack, so the next run is whole when it is wanted. Memory: two runs and a stack a level.
    """
    span = [ARITY ** (h + 1) for h in range(levels)]
    runs, ahead, fed = [], [], []

    def feed(h: int) -> None:
        if fed[h] < n:
            ahead[h].push(leaf_at(fed[h]))
            fed[h] += 1
            if fed[h] == n:
                ahead[h].close()

    for h in range(levels):  # the first runs
        ahead.append(TreeHash(h))
        fed.append(0)
        for _ in range(span[h]):
            feed(h)
        runs.append(ahead[h].out)
        ahead[h] = TreeHash(h)
    for i in range(n):
        for h in range(levels):
            if i and i % span[h] == 0:
                runs[h] = ahead[h].out
                ahead[h] = TreeHash(h)
            feed(h)
        yield [(i // ARITY**h % ARITY, runs[h]) for h in range(levels)]


def folded(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The node that a leaf and the siblings of its path give."""
    for at, run in path:
        leaf = digest([*run[:at], leaf, *run[at + 1 :]])
    return leaf


def siblings(path: list[tuple[int, list[str]]]) -> list[str]:
    """The others of each run of a path, left to right, level by level."""
    return [d for at, run in path for i, d in enumerate(run) if i != at]


def field(value: Column) -> Column:
    """A field of a leaf: its UTF-8 bytes' number, a colon and itself; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, s, leaf, tampered): each row's digest over doc_id, source, lang, n_chars and text, and the digest of the row as it is after tampering, null where it isn't tampered with: where 5 divides the CRC of doc_id, A-Z of the text are lower-cased. s: the source as a key that sorts like it, null first."""
    whole = lambda text: F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    s = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    low = F.translate("text", UPPER, LOWER)
    return docs.select("doc_id", s.alias("s"), whole(F.col("text")).alias("leaf"), F.when(hit, whole(low)).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with i, their place from 0 in their group by `order`, and n, how many the group has. One range partition by group and order, so a large group is spread over tasks; counted by (partition, group), whose offsets are joined back."""
    keys = [group, *order]
    at = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = written(at)
    part = F.shiftright("_at", 33)
    counts = at.groupBy(F.col(group).alias("_g"), part.alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    counts = cut(counts)
    # a group has at most one row a partition here
    group_ = Window.partitionBy("_g")
    upto = F.sum("_n").over(group_.orderBy("_p"))
    offsets = cut(counts.select("_g", F.col("_p").alias("p"), F.col("_first").alias("first"), (upto - F.col("_n")).alias("start"), F.sum("_n").over(group_).alias("n")))
    j = with_small(at, offsets, (F.col(group) == F.col("_g")) & (part == F.col("p")), "inner")
    return j.withColumn("i", F.col("start") + F.col("_at") - F.col("first")).drop("_at", "_g", "p", "first", "start")


def block_roots(placed: DataFrame) -> DataFrame:
    """(s, block, n, node): of each aligned block of a group's leaves the node they make; a group of one block goes up to its root, blocks of a larger one up DEEP levels. placed: (s, i, n, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, out = None, TreeHash(0), []

        def end() -> None:
            if now is not None:
                stack.close()
                out.append((*now, stack.out[0]))

        for b in batches:
            for s, block, n, leaf in zip(*(b.column(c).to_pylist() for c in ("s", "block", "n", "leaf")), strict=True):
                if (s, block, n) != now:
                    end()
                    now, stack = (s, block, n), TreeHash(min(DEEP, levels_of(n)))
                stack.push(leaf)
            if out:
                yield _rows(out)
                out.clear()
        end()
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("s", "block", "n", "node"), r, strict=True)) for r in out], schema=pa.schema([("s", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    d = placed.select("s", F.expr(f"i div {BLOCK}").alias("block"), "n", "i", "leaf").repartition("s", "block").sortWithinPartitions("s", "block", "i")
    return d.select("s", "block", "n", "leaf").mapInArrow(run, "s string, block long, n long, node string")


def upper_paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, roots): above the nodes (s, block, node) of each group, (s, block, path array<struct<at, run>>) from the lowest level up and (s, root). Each level is one aggregation over a sixteenth of the rows of the one below and one join that adds its run to the paths; a level's runs are shared by all blocks under them."""
    level = nodes.select("s", F.col("block").alias("pos"), "node")
    kind = "array<struct<at:int,run:array<string>>>"
    paths = nodes.select("s", "block", F.col("block").alias("_up"), F.array().cast(kind).alias("path"))
    done = []
    while True:
        sizes = cut(level.groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")))
        done.append(sizes.where("c = 1").select("s", F.col("node").alias("root")))
        more = sizes.where("c > 1").select(F.col("s").alias("_s"))
        if more.isEmpty():
            break
        live = with_small(level, more, F.col("s") == F.col("_s"), "left_semi")
        runs = live.groupBy("s", F.expr(f"pos div {ARITY}").alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("r"))
        runs = cut(runs.select("s", "pos", F.transform("r", lambda x: x["node"]).alias("run")))
        level = runs.select("s", "pos", F.sha2(F.array_join("run", ""), 256).alias("node"))
        told = runs.select(F.col("s").alias("r_s"), F.col("pos").alias("r_pos"), "run")
        step = F.struct((F.col("_up") % ARITY).cast("int").alias("at"), "run")
        up = F.expr(f"_up div {ARITY}")
        j = with_small(paths, told, (F.col("s") == F.col("r_s")) & (up == F.col("r_pos")))
        paths = cut(j.select("s", "block", up.alias("_up"), F.when(F.col("run").isNull(), F.col("path")).otherwise(F.array_append("path", step)).alias("path")))
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return paths.select("s", "block", "path"), cut(roots)


def _walk(rows: pa.Table) -> tuple[pa.Table, int, int]:
    """The rows of a block in order, how many there are and the levels inside it."""
    rows = rows.sort_by("i")
    return rows, rows.num_rows, min(DEEP, levels_of(rows.column("n")[0].as_py()))


def whole_paths(placed: DataFrame, upper: DataFrame) -> DataFrame:
    """(s, i, path): the whole path of each leaf of small groups (the sources)."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        rows, n, levels = _walk(block)
        leaf = rows.column("leaf").to_pylist()
        end = [(p["at"], p["run"]) for p in above.column("path")[0].as_py()]
        out = [[{"at": at, "run": list(r)} for at, r in [*path, *end]] for path in traversed(leaf.__getitem__, n, levels)]
        kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))
        return pa.table([rows.column("s"), rows.column("i"), pa.array(out, kind)], names=["s", "i", "path"])

    d = placed.select("s", F.expr(f"i div {BLOCK}").alias("block"), "i", "n", "leaf")
    return d.groupBy("s", "block").cogroup(upper.groupBy("s", "block")).applyInArrow(run, "s string, i long, path array<struct<at:int,run:array<string>>>")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, i, leaf, subroot, root, proof_sha256, folded_root, verified): every row of docs as a leaf of its source's tree, the subroots, by source, as leaves of the tree over all, the digest of the leaf's siblings, and whether the row, tampered with where leaves() says so, folds to the root.

    Null fields are told as -, empty ones as 0:, so they differ. Null doc_ids come first and aren't tampered with; rows of equal doc_id go by their digests, rows equal in all fields are one leaf each. The null source is a source of its own, before all. An empty table gives an empty result; other columns, whatever their names, aren't looked at.

    Leaves are numbered by one range partition over (source, doc_id), so a source may be of any size. Each aligned block of 4096 leaves is walked by one task, whose stacks hold two runs a level; above, each level is a sixteenth of the one below, and its runs are joined to the blocks.
    """
    kind = dict(docs.dtypes)["doc_id"]
    placed = written(numbered(written(leaves(docs)), "s", ["doc_id", "leaf"]))
    roots = written(block_roots(placed))
    upper, subroots = upper_paths(roots)
    # the tree over the sources: the same, with the one group of all
    sources = written(numbered(subroots.select(F.lit("").alias("g"), F.col("s").alias("source_key"), F.col("root").alias("leaf")), "g", ["source_key"]).withColumnRenamed("g", "s"))
    over, top = upper_paths(cut(block_roots(sources)))
    ends = whole_paths(sources, over).join(sources.select("s", "i", "source_key", "leaf"), ["s", "i"])
    ends = ends.join(top.select("s", F.col("root").alias("top")), "s")
    ends = cut(ends).select(F.col("source_key").alias("k"), F.col("path").alias("end"), F.col("leaf").alias("subroot"), "top")
    above = with_small(upper, ends, F.col("s") == F.col("k"), "inner").select("s", "block", F.concat("path", "end").alias("path"), "subroot", "top")
    names = ["doc_id", "s", "i", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        rows, n, levels = _walk(block)
        leaf, tampered = (rows.column(c).to_pylist() for c in ("leaf", "tampered"))
        end = [(p["at"], p["run"]) for p in above.column("path")[0].as_py()]
        end_siblings = "".join(siblings(end))
        proofs, roots = [], []
        for i, path in enumerate(traversed(leaf.__getitem__, n, levels)):
            proofs.append(digest([*siblings(path), end_siblings]))
            roots.append(folded(tampered[i] or leaf[i], [*path, *end]))
        subroot, top = (pa.array([above.column(c)[0].as_py()] * n) for c in ("subroot", "top"))
        return pa.table([*(rows.column(c) for c in ("doc_id", "s", "i", "leaf")), subroot, top, pa.array(proofs), pa.array(roots)], names=names)

    d = placed.withColumn("block", F.expr(f"i div {BLOCK}"))
    schema = f"doc_id {kind}, s string, i long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = d.groupBy("s", "block").cogroup(above.groupBy("s", "block")).applyInArrow(run, schema)
    source = F.when(F.col("s") != "", F.substring("s", 2, 1 << 30))
    return out.select("doc_id", source.alias("source"), "i", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest() of all documents: one row a row, nulls, empty texts and repeated rows included."""
    m = manifest(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle(levels: int = 6, over: int = 3) -> str:
    """The query in SQL for sources of at most 16^levels rows and at most 16^over sources: each level of the trees one step."""
    f = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    head = " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = "list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), {step}, CAST(4294967295 AS BIGINT))"
    bits = "xor(a, b)"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)[1]"
    crc = f"xor({crc.format(step=f'lambda a, b: {bits}')}, 4294967295)"
    steps = [f"""l AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
         sha256({head} || {f("text")}) AS h, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {f(low)}) END AS t
  FROM documents)"""]

    def tree(p: str, leaves: str, top: int) -> None:
        steps.append(f"{p}0 AS MATERIALIZED ({leaves})")
        for k in range(top):
            steps.append(f"{p}r{k} AS MATERIALIZED (SELECT s, i // 16 AS i, list(h ORDER BY i) AS hs FROM {p}{k} WHERE s IN (SELECT s FROM {p}{k} GROUP BY s HAVING count(*) > 1) GROUP BY s, i // 16)")
            steps.append(f"{p}{k + 1} AS MATERIALIZED (SELECT s, i, sha256(array_to_string(hs, '')) AS h FROM {p}r{k} UNION ALL SELECT s, 0, h FROM {p}{k} WHERE s IN (SELECT s FROM {p}{k} GROUP BY s HAVING count(*) = 1))")

    def walk(p: str, top: int, out: str) -> None:
        for k in range(top):
            at = f"(i // {16**k}) % 16"
            steps.append(f"""{out}{k + 1} AS MATERIALIZED (
  SELECT d.* EXCLUDE (f, sib), CASE WHEN r.hs IS NULL THEN f ELSE sha256(array_to_string(hs[1:{at}], '') || f || array_to_string(hs[{at} + 2:], '')) END AS f,
         sib || CASE WHEN r.hs IS NULL THEN '' ELSE array_to_string(hs[1:{at}], '') || array_to_string(hs[{at} + 2:], '') END AS sib
  FROM (SELECT *, i // {16 ** (k + 1)} AS up FROM {out}{k}) d LEFT JOIN (SELECT s AS rs, i AS ri, hs FROM {p}r{k}) r ON d.s = rs AND up = ri)""".replace("d.* EXCLUDE (f, sib)", "d.* EXCLUDE (f, sib, up)"))

    tree("a", "SELECT s, i, h FROM l", levels)
    steps.append(f"sub AS MATERIALIZED (SELECT s AS src, row_number() OVER (ORDER BY s) - 1 AS i, '' AS s, h FROM a{levels})")
    tree("b", "SELECT s, i, h FROM sub", over)
    steps.append("x0 AS MATERIALIZED (SELECT doc_id, s, i, h, coalesce(t, h) AS f, '' AS sib FROM l)")
    walk("a", levels, "x")
    steps.append(f"y0 AS MATERIALIZED (SELECT x.doc_id, x.h, sub.h AS subroot, sub.s, sub.i, x.f, x.sib FROM x{levels} x JOIN sub ON x.s = sub.src)")
    walk("b", over, "y")
    return f"""WITH {", ".join(steps)}
SELECT doc_id, y.h AS leaf, subroot, b.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = b.h AS verified FROM y{over} y CROSS JOIN b{over} b"""


ORACLE = oracle()
