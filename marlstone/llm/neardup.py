"""Components of documents whose shingle sets have a Jaccard similarity of at least a threshold.

The join is exact and adaptive.  Shingles are ordered by how many documents
have them, rarest first.  Two sets that are similar enough share at least l
shingles among the first ``n - least overlap + l`` of each, for any l.  Each
document picks its own l: a longer prefix reads more posting lists, but asks
for more shared entries before a pair is verified.  The l of least estimated
cost is taken from the sizes of the lists that each prefix would read.  Where
two documents meet, their sizes give the overlap that just this pair needs, and
what of it may lie behind the prefixes; the rest must be shared in them.
No pair shares more than what either document has in common with any other, so
that a document also knows the largest partner it can have: documents with a
template in common and a seventh of their own never meet.

Only what can link travels.  Documents with the same set are one class.  A
document whose shingles are mostly found nowhere else has no partner and leaves
after one exchange of compact hashes.  Groups of thousands of near copies are
never paired off: in some rounds every posting list compares its members with
one of them only, members that meet in one verification group are explored
together, and what is connected by then needs no further pair.  The last step
looks up every pair of a posting list that is still in two components.

Shingles are 48-bit hashes, compared within pairs of documents and counted
over the corpus; a false equality needs two of the shingles of one pair to
collide.

Nodes are shingle sets, numbered once, so ids need not be unique.  A shingle
that very many documents of a batch have goes to its shard as one count; which
documents have it stays with the batch.

Defined cases: a null or empty text, or one without words, has an empty set
and links with nothing; a text of fewer words than a shingle is one shingle of
all its words; repeated rows are copies; rows of one id with different texts are
documents of their own; a null id has its row and links, but never names a
component, so one of null ids only has a null name; an empty table gives no
rows; other columns of the input play no part; a very long text is one piece,
whose arrays take a small multiple of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import shards, written
from marlstone.llm.spans import Piece, in_pieces, mix

WORDS = 5
#: Similarity in hundredths.
PERCENT = 75
#: Shingles that a task holds before it deals them out.
HELD = 1_000_000
#: Documents of a dealt batch; their places take two bytes.
BATCH_DOCS = 60_000
#: Members of a verification group besides its pivot, and their shingles.
GROUP = 1000
GROUP_SHINGLES = 1_000_000
#: A shingle of more documents of a batch goes to its shard as a count.
COMMON = 500
#: Rounds in which posting lists compare with one member.
ROUNDS = 3
_BITS = np.uint64(16)
_LAST = np.iinfo(np.int64).max


def shingles(piece: Piece, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of each document of a piece, by row and hash."""
    h, bounds = piece.hash(*piece.words), piece.word_bounds
    doc = piece.doc_of(bounds)
    with np.errstate(over="ignore"):
        whole = h[: max(0, len(h) - words + 1)].copy()
        for k in range(1, words):
            whole = mix(whole * np.uint64(3) + h[k : len(h) - words + 1 + k])
        inside = doc[words - 1 :] == doc[: max(0, len(doc) - words + 1)]
        rows, found = doc[words - 1 :][inside], whole[inside]
        n = np.diff(bounds)
        short = np.flatnonzero((n > 0) & (n < words))
        one = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = n[short] > k
            one[has] = mix(one[has] * np.uint64(5) + h[bounds[short[has]] + k] + np.uint64(1))
    rows, found = np.concatenate([rows, short]), np.concatenate([found, one]) >> _BITS
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]


def _squeeze(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit integers as planes of the bytes of their differences; high planes are mostly zero and compress away."""
    steps = np.diff(ascending, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _expand(raw: bytes) -> np.ndarray:
    planes = np.zeros((len(raw) // 7, 8), np.uint8)
    planes[:, :7] = np.frombuffer(raw, np.uint8).reshape(7, -1).T
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=np.uint64)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles without which no other set is similar enough to one of size n."""
    return -(-n * percent // 100)


def adaptive_prefix(n: int, df: np.ndarray, percent: int) -> int:
    """Length of the prefix for the l chosen, of the shingles in df, which are n or fewer and the last in rarest-first order.

    Of l = 1, 2, ... the one of least cost: entries of the posting lists read, and, for the at most (entries / l) pairs
    that can share l of them, the comparison of two sets.
    """
    alone = n - len(df)
    shortest = n - int(least_overlap(np.int64(n), percent)) + 1 - alone
    if shortest > len(df):
        return len(df)
    reads = np.cumsum(df)[max(0, shortest - 1) :].astype(np.float64)
    if shortest <= 0:
        reads = np.concatenate([np.zeros(1 - shortest), reads])
    reads = reads[: 2 + n // 8]
    l = int(np.argmin(reads + reads / np.arange(1, len(reads) + 1) * (4 + n / 16))) + 1
    return max(0, min(len(df), shortest - 1 + l))


#: A row of tokens has owners or, for what is common in the batch, counts; the row about documents has the common tokens, their counts and owners.
_DEALT = "shard int, batch long, ids array<long>, carried array<long>, sizes binary, digests binary, tokens binary, owners binary, counts binary, df binary"


def _dealt(docs: DataFrame, words: int, common: int) -> DataFrame:
    """Batches of documents: a row of their ids, set sizes and set digests, and rows for each shard of (shingle, place of the document)."""
    n_shards = shards(docs)
    names = [c.split()[0] for c in _DEALT.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 6]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list = []
        carried: list = []
        digests: list[bytes] = []
        sizes: list[np.ndarray] = []
        part, seq, many = TaskContext.get().partitionId(), 0, 0

        def close() -> pa.RecordBatch:
            owner, token = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            # with its place, so that equal batches, as of a file read twice, stay apart
            name = hashlib.blake2b(repr((part, seq, ids, carried)).encode() + b"".join(digests), digest_size=7).digest()
            batch = int.from_bytes(name, "big")
            shard = (mix(token) % np.uint64(n_shards)).astype(np.int32)
            order = np.lexsort((token, shard))
            owner, token, shard = owner[order].astype("<u2"), token[order], shard[order]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            n = np.diff(np.append(starts, len(token)))
            often = np.repeat(n > common, n)
            counted, counts = token[starts[n > common]], n[n > common].astype("<u4")
            rows = [(-1 - batch % n_shards, batch, ids, carried, np.concatenate(sizes).astype("<u4").tobytes(), b"".join(digests), counted.astype("<u8").tobytes(), owner[often].tobytes(), counts.tobytes(), None)]
            at = shard[starts[n > common]]
            for s in np.unique(at):
                rows.append((int(s), batch, *[None] * 4, _squeeze(counted[at == s]), None, counts[at == s].tobytes(), None))
            owner, token, shard = owner[~often], token[~often], shard[~often]
            cuts = np.searchsorted(shard, np.arange(n_shards + 1))
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    rows.append((s, batch, *[None] * 4, _squeeze(token[a:b]), owner[a:b].tobytes(), None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for rows, piece in in_pieces(batches, "text", fold=True):
            owner, token = shingles(piece, words)
            n = np.bincount(owner, minlength=piece.n)
            edges = np.concatenate([[0], np.cumsum(n)])
            raw = token.astype("<u8").tobytes()
            held.append((owner + len(ids), token))
            sizes.append(n)
            digests += [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            ids += rows.column("id").to_pylist()
            carried += rows.column("carried").to_pylist()
            many += len(token)
            if many >= HELD or len(ids) >= BATCH_DOCS // 2:
                yield close()
                held, ids, carried, digests, sizes, seq, many = [], [], [], [], [], seq + 1, 0
        if ids:
            yield close()

    return docs.mapInArrow(run, _DEALT)


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of a shard's rows, what at least two documents have, with its document frequency; rows about documents pass."""
    if key[0].as_py() < 0:
        return table
    parts = [_expand(t) for t in table.column("tokens").to_pylist()]
    counts = [np.ones(len(p), np.uint32) if c is None else np.frombuffer(c, "<u4") for p, c in zip(parts, table.column("counts").to_pylist(), strict=True)]
    owners = [np.zeros(len(p), "<u2") if o is None else np.frombuffer(o, "<u2") for p, o in zip(parts, table.column("owners").to_pylist(), strict=True)]
    listed = table.column("owners").is_valid().to_pylist()
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    token, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(token, kind="stable")
    token = token[order]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    df = np.repeat(np.add.reduceat(np.concatenate(counts)[order], starts, dtype=np.int64), np.diff(np.append(starts, len(token))))
    some = df >= 2
    token, owner, row, df = token[some], owner[order][some], row[order][some], df[some]
    order = np.argsort(row, kind="stable")  # within a row still by shingle
    token, owner, row, df = token[order], owner[order], row[order], np.minimum(df[order], 2**32 - 1)
    cuts = np.searchsorted(row, np.arange(len(parts) + 1))
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    found = {"tokens": [_squeeze(token[a:b]) for a, b in spans], "owners": [owner[a:b].tobytes() if x else None for (a, b), x in zip(spans, listed, strict=True)], "df": [df[a:b].astype("<u4").tobytes() for a, b in spans]}
    for name, values in found.items():
        table = table.set_column(table.column_names.index(name), name, pa.array(values, pa.binary()))
    return table


_CLASS = "id long, digest binary, n int, prefix int, tokens array<long>"


def _assembled(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A batch's documents that enough other documents share shingles with: their common shingles, rarest first, and prefix."""
        about = next(i for i, x in enumerate(table.column("ids").is_valid().to_pylist()) if x)
        ids, digests = table.column("ids")[about].as_py(), table.column("digests")[about].as_py()
        sizes = np.frombuffer(table.column("sizes")[about].as_py(), "<u4").astype(np.int64)
        raw = [(_expand(t), o, np.frombuffer(d, "<u4")) for t, o, d in zip(table.column("tokens").to_pylist(), table.column("owners").to_pylist(), table.column("df").to_pylist(), strict=True) if d]
        empty = np.zeros(0, np.uint64)
        here = np.repeat(np.frombuffer(table.column("tokens")[about].as_py(), "<u8"), np.frombuffer(table.column("counts")[about].as_py(), "<u4"))
        token = np.concatenate([*(t for t, o, _ in raw if o is not None), here, empty])
        owner = np.concatenate([*(np.frombuffer(o, "<u2") for _, o, _ in raw if o is not None), np.frombuffer(table.column("owners")[about].as_py(), "<u2"), empty]).astype(np.int64)
        common = {t: d for ts, o, ds in raw if o is None for t, d in zip(ts.tolist(), ds.tolist(), strict=True)}
        df = np.concatenate([*(d for _, o, d in raw if o is not None), np.array([common[t] for t in here.tolist()]), empty]).astype(np.int64)
        enough = np.bincount(owner, minlength=len(sizes)) >= least_overlap(sizes, percent)
        some = enough[owner]
        token, owner, df = token[some], owner[some], df[some]
        order = np.lexsort((token, df, owner))
        token, owner, df = token[order], owner[order], df[order]
        edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
        rows = []
        for i in np.flatnonzero(enough & (sizes > 0)):
            a, b = edges[i], edges[i + 1]
            prefix = adaptive_prefix(int(sizes[i]), df[a:b], percent)
            if prefix:
                rows.append((ids[i], digests[16 * i : 16 * i + 16], int(sizes[i]), prefix, token[a:b].astype(np.int64)))
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=[c.split()[0] for c in _CLASS.split(", ")])

    return run


def explore(sizes: np.ndarray, sets: list[np.ndarray], percent: int, starts: np.ndarray | None = None) -> np.ndarray:
    """For each set of a group, the first start (of all sets, or those given) that links reach it from, -1 if none does.

    A set is compared with those not reached yet only.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    mark = np.zeros(int(token.max()) + 1, bool)
    root = np.full(len(sets), -1)
    away, away_token = owner, token
    for first in range(len(sets)) if starts is None else starts.tolist():
        if root[first] >= 0:
            continue
        root[first] = first
        todo = [first]
        while todo:
            if not len(away):
                return root
            x = todo.pop()
            mine = token[edges[x] : edges[x + 1]]
            mark[mine] = True
            common = np.bincount(away[mark[away_token]], minlength=len(sets))
            mark[mine] = False
            near = np.flatnonzero((root < 0) & (common * 100 >= percent * (sizes + sizes[x] - common)) & (common > 0))
            if len(near):
                root[near] = first
                todo += near.tolist()
                left = root[away] < 0
                away, away_token = away[left], away_token[left]
    return root


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold the linked members of each (pivot, cls) group together. Large groups are split, each part with the pivot."""
    parts = pairs.groupBy("pivot").agg(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES).cast("int").alias("parts"))
    dealt = written(pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("cls"), F.col("parts") + 1).alias("part"), "cls"), "dealt-pairs")
    heads = dealt.select("pivot", "part").distinct().withColumn("cls", F.col("pivot"))
    return _explored(dealt.unionByName(heads).withColumn("asks", F.lit(True)), ["pivot", "part"], classes, percent)


def _explored(groups: DataFrame, key: list[str], classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold what members marked ``asks`` reach in each group together."""
    members = groups.join(classes.select("cls", "n", "tokens"), "cls")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls").combine_chunks()
        ids = table.column("cls").to_numpy()
        sets = [np.asarray(s) for s in table.column("tokens").combine_chunks().to_numpy(zero_copy_only=False)]
        starts = np.flatnonzero(table.column("asks").to_numpy())
        root = explore(table.column("n").to_numpy().astype(np.int64), sets, percent, starts)
        linked = (root >= 0) & (root != np.arange(len(ids)))
        return pa.table([pa.array(ids[linked]), pa.array(ids[root[linked]])], names=["a", "b"])

    return members.groupBy(*key).applyInArrow(run, "a long, b long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cls, label) after links (a, b) between classes: every label is the least of what is reached from it.

    Labels are the nodes: each hooks to its least neighbour, chains of hooks are followed by doubling, and links between
    what has become one are dropped, until none is left.
    """
    of = labels.select("cls", "label")
    edges = written(links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").where("la <> lb").select("la", "lb").distinct(), "edges")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
        up = written(both.groupBy("la").agg(F.min("lb").alias("to")).where("to < la").toDF("node", "to"), "hooks")
        while True:
            further = up.toDF("to", "beyond")
            step = up.join(further, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved"))
            step = written(step, "hooks")
            up = step.select("node", "to")
            if not step.where("moved").limit(1).count():
                break
        labels = written(labels.join(up.toDF("label", "to"), "label", "left").select("cls", F.coalesce("to", "label").alias("label")), "labels")
        a, b = up.toDF("la", "ta"), up.toDF("lb", "tb")
        edges = written(edges.join(a, "la", "left").join(b, "lb", "left").select(F.coalesce("ta", "la").alias("la"), F.coalesce("tb", "lb").alias("lb")).where("la <> lb").distinct(), "edges")
    return labels


def _round(postings: DataFrame, labels: DataFrame, percent: int, number: int) -> DataFrame:
    """Pairs (pivot, cls, n) that share enough entries: each posting list compares its members with the one that this round's hash puts first.

    A pair that is similar enough shares at least its needed overlap less what lies behind the prefix that ends first,
    and neither is larger than the other's ``most``.
    """
    listed = postings.join(labels, "cls")
    member = F.struct(F.col("cls").alias("pivot"), F.col("label").alias("pl"), F.col("n").alias("pn"), F.col("behind").alias("pb"), F.col("most").alias("pm"))
    pivots = listed.groupBy("token").agg(F.min_by(member, F.struct(F.xxhash64("cls", F.lit(number)), "cls")).alias("p"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = listed.join(pivots.where("low <> high").select("token", "p.*"), "token").where("label <> pl").where(F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent).where("n <= pm and pn <= most")
    needed = F.ceil(percent * (F.col("n") + F.col("pn")) / (100 + percent)) - F.greatest("behind", "pb")
    return met.groupBy("pivot", "cls").agg(F.count("*").alias("common"), F.min(needed).alias("needed"), F.min("n").alias("n")).where("common >= needed").select("pivot", "cls", "n")


def _band(size: Column) -> Column:
    """Sizes that differ by less than two thirds are in one band or in neighbours; larger sizes are never in lower bands."""
    return F.floor(F.log(size.cast("double")) * 2)


def _rest(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Groups (token, chunk, block) of classes that hold every pair of classes in different components with enough common entries.

    The member in the smaller component asks. Lists are cut by the members' sizes, into bands, and by a hash of the member,
    into chunks; who asks gets the lists of the sizes that a partner can have, unless all in them can only have smaller
    partners. What one asking class meets in one chunk is counted together. Askers with the same longest list meet mostly the same classes, so a block
    of them is verified as one group, in which each class is once: pairs have no rows of their own.
    """
    size = labels.groupBy("label").agg(F.count("*").cast("int").alias("size"))
    listed = postings.join(labels.join(size, "label"), "cls")
    key = F.struct("size", "label")
    mixed = listed.groupBy("token").agg(F.max(key).alias("top"), F.min(key).alias("least"), F.count("*").alias("many"), F.sum("n").alias("weight")).where("top <> least")
    mixed = written(mixed, "mixed-lists")
    longest, heaviest = (int(x or 0) for x in mixed.agg(F.max("many"), F.max("weight")).first())
    chunks = 1 + max(longest // (2 * GROUP), heaviest // (2 * GROUP_SHINGLES))
    listed = written(listed.join(mixed.select("token", "top", "many"), "token"), "mixed-postings")
    columns = ["cls", "n", "behind", "most", "size", "label"]
    cut = listed.withColumns({"band": _band(F.col("n")), "chunk": F.pmod(F.xxhash64("cls"), F.lit(chunks))})
    lists = cut.groupBy("token", "band", "chunk").agg(*(F.collect_list(c).alias(f"{c}s") for c in columns), F.max("most").alias("accepts"))
    least, largest = F.ceil(F.col("n") * percent / 100), F.least(F.floor(F.col("n") * 100 / percent), "most")
    asking = listed.where(key < F.col("top")).select("token", "many", *columns, F.explode(F.sequence(_band(least), _band(largest))).alias("band"))
    met = asking.join(lists, ["token", "band"]).where("n <= accepts")

    def count(table: pa.Table) -> pa.Table:
        mine = {c: table.column(c)[0].as_py() for c in columns}
        other = {c: table.column(f"{c}s").combine_chunks().flatten().to_numpy().astype(np.int64) for c in columns}
        higher = (other["size"] > mine["size"]) | ((other["size"] == mine["size"]) & (other["label"] > mine["label"]))
        fits = higher & (np.minimum(other["n"], mine["n"]) * 100 >= percent * np.maximum(other["n"], mine["n"])) & (other["n"] <= mine["most"]) & (other["most"] >= mine["n"])
        found, at, common = np.unique(other["cls"][fits], return_index=True, return_counts=True)
        needed = -(-percent * (other["n"][fits][at] + mine["n"]) // (100 + percent)) - np.maximum(other["behind"][fits][at], mine["behind"])
        found = found[common >= needed]
        token = max(zip(table.column("many").to_pylist(), table.column("token").to_pylist(), strict=True))[1]
        rows = [(token, table.column("chunk")[0].as_py(), mine["cls"], found)] if len(found) else []
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["token", "chunk", "pivot", "met"])

    asks = written(met.groupBy("cls", "chunk").applyInArrow(count, "token long, chunk long, pivot long, met array<long>"), "asks")
    blocks = asks.groupBy("token", "chunk").agg((F.count("*") / (GROUP // 2)).cast("int").alias("blocks"))
    dealt = asks.join(blocks, ["token", "chunk"]).withColumn("block", F.pmod(F.xxhash64("pivot"), F.col("blocks") + 1))

    def united(key: tuple, table: pa.Table) -> pa.Table:
        askers = table.column("pivot").to_numpy()
        classes = np.union1d(askers, table.column("met").combine_chunks().flatten().to_numpy())
        same = [pa.array(np.full(len(classes), k.as_py(), np.int64)) for k in key]
        return pa.table([*same, pa.array(classes), pa.array(np.isin(classes, askers))], names=["token", "chunk", "block", "cls", "asks"])

    return dealt.groupBy("token", "chunk", "block").applyInArrow(united, "token long, chunk long, block long, cls long, asks boolean")


def linked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS, carry: str | None = None, common: int = COMMON
) -> DataFrame:
    """(id, n_shingles, component_id, component, carried) of every document.

    component_id is the least id that links reach, its own included; component is a number of just this component (null
    for empty sets), also where ids repeat; carried is the long column ``carry`` of the row.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.col(carry) if carry else F.lit(None)).cast("long").alias("carried"))
    dealt = written(_dealt(texts, words, common).groupBy("shard").applyInArrow(_shared, _DEALT), "shared-shingles")

    def about(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, carried, sizes, digests in zip(*(batch.column(c).to_pylist() for c in ("ids", "carried", "sizes", "digests")), strict=True):
                columns = [pa.array(ids, pa.int64()), pa.array(carried, pa.int64()), pa.array(np.frombuffer(sizes, "<u4").astype(np.int64)), pa.array([digests[k : k + 16] for k in range(0, len(digests), 16)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "carried", "n", "digest"])

    every = written(dealt.where("ids is not null").select("ids", "carried", "sizes", "digests").mapInArrow(about, "id long, carried long, n long, digest binary"), "set-digests")
    last = F.lit(int(_LAST))
    # Written, so that numbers stay, and the join below reads two exchanges and a digest of very many copies can be split.
    names = written(every.where("n > 0").groupBy("digest").agg(F.min(F.coalesce("id", last)).alias("low")).withColumn("cls", F.monotonically_increasing_id()), "set-names")
    rich = dealt.groupBy("batch").applyInArrow(_assembled(percent), _CLASS).withColumn("low", F.coalesce("id", last))
    firsts = rich.join(names, ["digest", "low"]).dropDuplicates(["cls"])
    # n + size of partner <= shared * (100 + percent) / percent, and no more is shared than tokens
    most = F.expr(f"cast(size(tokens) as long) * {100 + percent} div {percent} - n")
    classes = written(firsts.select("cls", "n", (F.size("tokens") - F.col("prefix")).alias("behind"), most.alias("most"), "prefix", "tokens"), "classes")
    postings = classes.select("cls", "n", "behind", "most", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token"))
    several = postings.groupBy("token").count().where("count > 1").select("token")
    postings = written(postings.join(several, "token"), "postings")
    labels = classes.select("cls", F.col("cls").alias("label"))
    for number in range(rounds):
        labels = components(labels, written(_verified(_round(postings, labels, percent, number), classes, percent), "links"))
    labels = components(labels, written(_explored(written(_rest(postings, labels, percent), "last-groups"), ["token", "chunk", "block"], classes, percent), "links"))
    of_set = names.join(labels, "cls", "left").select("digest", "low", F.coalesce("label", "cls").alias("component"))
    least = of_set.groupBy("component").agg(F.min("low").alias("low"))
    named = every.join(of_set.drop("low").join(least, "component"), "digest", "left")
    component_id = F.when(F.col("n") > 0, F.nullif("low", last)).otherwise(F.col("id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.when(F.col("n") > 0, F.col("component")).alias("component"), "carried")
