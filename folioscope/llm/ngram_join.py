"""Jaccard join of shingle sets by token-combination prefixes.

A document's tokens are its distinct four-word shingles (A-Z lower-cased, words are runs without ASCII white space; fewer
words: one token of all). Two documents link if 100 * intersection >= PERCENT * union. Documents with equal sets are one
class; classes are joined, and a document's links are its class's copies and the documents of the classes it links to.

Signatures. Tokens have a level: rare, frequent or very frequent, from the counts below. All sets are ordered by (level,
hash). Of x at most t = n - ceil(PERCENT * n / 100) tokens can be missing in a partner. Rare tokens are signatures by
themselves; frequent ones are dealt into subclasses and give combinations of two per subclass, very frequent ones of three.
A subclass with m tokens in the prefix and k-token combinations loses its last combination only after m - k + 1 misses, so
the prefix is extended until the sum of max(0, m - k + 1) over rare tokens and subclasses exceeds t; then two linked sets
share a signature. The number of subclasses follows the size class (a power of two), which is part of the signature;
a set near the lower border of its class posts for the class below too, since a partner may be there. Size classes below
FIRST_SPLIT have single tokens only.

Levels need no exact counts: any function of the token loses nothing. Each task counts the tokens of its distinct sets and
reports those it met twice (so a count is short by at most one per task); the HEAVY most counted ones are sent to all tasks.

Candidates. A bucket (a signature) of up to LIMIT classes gives its pairs of fitting sizes. Pairs whose parity sketches
differ in more bits than linked sets can differ in tokens go; the others are verified on the sets, which are made again from
the texts of candidate classes only. Larger buckets give a chain; chained classes are a
cluster, dealt into blocks by hash, and every two blocks meet once in a task that verifies all their pairs and returns a
forest and link counts, never the pairs. Tokens are 64-bit hashes; two shingles of one pair of documents that collide
would count as one (chance n * n / 2**64 for a pair).

Null and empty texts have no set: n_shingles 0, linked with nothing, their component is their own doc_id. Repeated rows are
documents of their own. A component's id is its smallest doc_id; null ids do not count, and a component of null ids has a
null id. Long texts are read whole. Other columns are not read. An empty table gives an empty result.
"""

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import components

WORDS = 4
PERCENT = 85
LIMIT = 48
HEAVY, FREQUENT, VERY_FREQUENT = 1 << 17, 48, 1024
FIRST_SPLIT = 4
SLICE = 1 << 20
COUNT_AT_ONCE = 1 << 22
BLOCK_CLASSES, BLOCK_TOKENS = 256, 1 << 18
KEY = ["k1", "k2", "n"]

B = np.uint64(0x9E3779B97F4A7C15)
B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# ---- sets of hashed shingles --------------------------------------------------------------------------------------

def mix(x):
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def then(h, x):
    return mix(h * B + x)


def byte_values():
    """A random number per byte, A-Z like a-z; and which bytes part words."""
    values = mix(np.arange(1, 257, dtype="u8") * B)
    values[65:91] = values[97:123]
    parts = np.zeros(256, bool)
    parts[[0x20, *range(0x09, 0x0E)]] = True
    return values, parts


VALUES, PARTS = byte_values()


@cache
def powers(n):
    up, down = np.full(n, B, "u8"), np.full(n, B_INVERSE, "u8")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sets_of(texts):
    """Sorted distinct token hashes of each text (bytes). Word hashes are differences of prefix sums of byte values times powers."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", "u1")
    up, down = powers(max(SLICE * 2, 1 << int(len(data)).bit_length()))
    part = PARTS[data]
    edge = np.flatnonzero(np.diff(part, prepend=True))
    first, last = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(VALUES[data] * up[: len(data)])])
    word = mix((sums[last] - sums[first]) * down[first])
    ends = np.cumsum([len(t) + 1 for t in texts])
    to = np.searchsorted(first, ends)
    gram = word[: max(0, len(word) - WORDS + 1)]
    for k in range(1, WORDS):
        gram = then(gram, word[k : k + len(gram)])
    out, a = [], 0
    for b in to.tolist():
        if b - a >= WORDS:
            out.append(np.unique(gram[a : b - WORDS + 1]))
        elif b > a:
            h = np.array([b - a], "u8")
            for k in range(a, b):
                h = then(h, word[k : k + 1])
            out.append(h)
        else:
            out.append(np.empty(0, "u8"))
        a = b
    return out


def each_set(batches):
    """(doc_id, set) of Arrow batches of (doc_id, text), some texts at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py().encode("utf-8", "surrogatepass") if text.is_valid else b"")
            held += len(texts[-1])
            if held >= SLICE:
                yield from zip(ids, sets_of(texts), strict=True)
                ids, texts, held = [], [], 0
    if ids:
        yield from zip(ids, sets_of(texts), strict=True)


def key_of(tokens):
    """128 bits that equal sets share."""
    a, b = mix(tokens + C1), mix(tokens * C2 + C1)
    return int(a.sum(dtype="u8").view("i8")), int(np.bitwise_xor.reduce(b).view("i8")) if len(b) else 0


# ---- levels -------------------------------------------------------------------------------------------------------

def count_tokens(batches):
    """Tokens that two or more distinct sets of this task hold, counted some millions at a time."""
    seen, held, n = set(), [], 0

    def counted():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[counts > 1].view("i8")), pa.array(counts[counts > 1].astype("i8"))], names=["token", "n"])

    for _, tokens in each_set(batches):
        if len(tokens) and (key := key_of(tokens)) not in seen:
            seen.add(key)
            held.append(tokens)
            n += len(tokens)
            if n >= COUNT_AT_ONCE:
                yield counted()
                seen, held, n = set(), [], 0
    if held:
        yield counted()


class Levels:
    """Level of a token: 1 rare, 2 frequent, 3 very frequent."""

    def __init__(self, tokens, counts):
        order = np.argsort(tokens)
        self.tokens, self.level = tokens[order], np.where(counts[order] >= VERY_FREQUENT, 3, 2)

    def of(self, tokens):
        if not len(self.tokens):
            return np.ones(len(tokens), "i8")
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.level[at], 1)


def levels(texts: DataFrame, frequent=FREQUENT) -> Levels:
    counted = texts.mapInArrow(count_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= frequent).orderBy(F.desc("n"), "token").limit(HEAVY).toPandas()
    return Levels(top["token"].to_numpy("i8").view("u8"), top["n"].to_numpy("i8"))


# ---- signatures ---------------------------------------------------------------------------------------------------

@cache
def choose(m, k):
    from itertools import combinations

    return np.array(list(combinations(range(m), k)), "i8").reshape(-1, k)


def may_miss(n):
    return n - -(-PERCENT * n // 100)


def size_classes(n):
    c = n.bit_length() - 1
    return [c, c - 1] if c and n - may_miss(n) < 1 << c else [c]


def prefix(tokens, level, c, needed):
    """The rare tokens, and per level the subclasses, of the shortest prefix that `needed` misses cannot empty of signatures."""
    rare = tokens[level == 1] if c >= FIRST_SPLIT else tokens
    if len(rare) >= needed:
        return rare[:needed], []
    needed, out = needed - len(rare), []
    for k, groups in ((2, max(1, (1 << c) // 32)), (3, max(1, (1 << c) // 16))):
        own = tokens[level == k]
        sub = (mix(own) % np.uint64(groups)).astype("i8")
        order = np.argsort(sub, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], sub[order][1:] != sub[order][:-1]])) if len(own) else np.empty(0, "i8")
        rank = np.empty(len(own), "i8")
        rank[order] = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        gained = np.cumsum(rank >= k - 1)
        end = int(np.searchsorted(gained, needed)) + 1
        out.append((k, own[:end], sub[:end]))
        if len(gained) and gained[-1] >= needed:
            return rare, out
        needed -= int(gained[-1]) if len(gained) else 0
    raise AssertionError("a set has too few tokens for its subclasses")


def signatures(tokens, of_levels):
    n, level, out = len(tokens), of_levels.of(tokens), []
    for c in size_classes(n):
        rare, classes = prefix(tokens, level, c, may_miss(n) + 1)
        salt = np.uint64(c)
        out.append(then(np.full(len(rare), salt, "u8"), rare))
        for k, own, sub in classes:
            for s in np.unique(sub):
                group = own[sub == s]
                if len(group) >= k:
                    picked = group[choose(len(group), k)]
                    h = np.full(len(picked), salt + np.uint64(100 * k), "u8")
                    for i in range(k):
                        h = then(h, picked[:, i])
                    out.append(h)
    return np.unique(np.concatenate(out))


def described(of_levels):
    """(doc_id, text) -> doc_id, key of the set, its signatures."""

    def run(batches):
        rows = []

        def closed():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", *KEY, "signatures", "sketch"])

        for doc_id, tokens in each_set(batches):
            rows.append((doc_id, *key_of(tokens), len(tokens), *((signatures(tokens, of_levels).tobytes(), sketch(tokens)) if len(tokens) else (None, None))))
            if len(rows) == 2048:
                yield closed()
        if rows:
            yield closed()

    return run


def sketch(tokens) -> bytes:
    """Parities of the tokens by hash, one to two bits a token: sketches of two sets differ in no more bits than the sets in tokens."""
    bits = max(64, 2 << (len(tokens).bit_length() - 1))
    odd = np.bincount((mix(tokens + C2) & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, sizes: int) -> bool:
    """Whether the sketches allow a link of two sets of `sizes` tokens together. The longer sketch is folded to the shorter."""
    if len(x) < len(y):
        x, y = y, x
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    width = 8 * len(x)
    while width > 8 * len(y):
        width //= 2
        a = (a >> width) ^ (a & ((1 << width) - 1))
    return (100 + PERCENT) * (a ^ b).bit_count() <= (100 - PERCENT) * sizes


# ---- candidates ---------------------------------------------------------------------------------------------------

def post(batches):
    for batch in batches:
        for id_, n, found in zip(*(batch.column(i) for i in range(3)), strict=True):
            sig = np.frombuffer(found.as_py(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.full(len(sig), id_.as_py())), pa.array(np.full(len(sig), n.as_py()))], names=["sig", "id", "n"])


def together(batches, rows=1 << 16):
    """Small batches joined to large ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def edges(a, b, chained):
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), chained))], names=["a", "b", "chained"])


def pairs_of(limit):
    """Rows sorted by signature -> candidate pairs of small buckets, chains through larger ones."""

    def closed(sig, ids, n):
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(starts, len(sig)))
        small = np.repeat(sizes <= limit, sizes)
        for step in range(1, int(sizes[sizes <= limit].max(initial=1))):
            x = np.flatnonzero((sig[:-step] == sig[step:]) & small[:-step])
            y = x + step
            fit = (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])) & (ids[x] != ids[y])
            if fit.any():
                x, y = ids[x[fit]], ids[y[fit]]
                yield edges(np.minimum(x, y), np.maximum(x, y), False)
        for s, size in zip(starts[sizes > limit], sizes[sizes > limit], strict=True):
            yield edges(ids[s : s + size - 1], ids[s + 1 : s + size], True)

    def run(batches):
        held = [np.empty(0, "i8")] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            open_ = int(np.searchsorted(held[0], held[0][-1], "left"))
            if open_:
                yield from closed(*(h[:open_] for h in held))
                held = [h[open_:] for h in held]
            if len(held[0]) > 1 << 16:  # one long bucket: its chain goes on with its last class
                yield edges(held[1][:-1], held[1][1:], True)
                held = [np.concatenate([h[:1]] * limit + [h[-1:]]) if i == 1 else np.repeat(h[-1:], limit + 1) for i, h in enumerate(held)]
        if len(held[0]):
            yield from closed(*held)

    return lambda batches: together(run(batches))


def screen(batches):
    for batch in batches:
        keep = [may_link(x.as_py(), y.as_py(), n) for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], names=["a", "b"])


def linked(common, n, m):
    return 100 * common >= PERCENT * (n + m - common)


def verify(batches):
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        keep = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            keep[k] = linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def verify_blocks(key, rows):
    """All pairs of two blocks of a cluster -> a forest (a, b) of the links, and (a, null, documents that a links to)."""
    one, two = key[1].as_py(), key[2].as_py()
    ids, block, copies = (rows[c].to_numpy() for c in ("id", "block", "copies"))
    sets = [np.frombuffer(s.as_py(), "<u8") for s in rows["set"]]
    sizes = np.array([len(s) for s in sets], "i8")
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    up, docs, a, b = list(range(len(sets))), np.zeros(len(sets), "i8"), [], []

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, tokens in enumerate(sets):
        if block[i] != one:
            continue
        lo, hi = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
        many = hi - lo
        spot = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        common = np.bincount(owner[spot], minlength=len(sets))
        near = linked(common, sizes[i], sizes) & (block == two)
        if one == two:
            near[: i + 1] = False
        at = np.flatnonzero(near)
        docs[i] += copies[at].sum()
        docs[at] += copies[i]
        for j in at.tolist():
            if (x := root(i)) != (y := root(j)):
                up[x] = y
                a.append(ids[i])
                b.append(ids[j])
    told = np.flatnonzero(docs)
    nothing = [None] * len(told)
    return pa.table({"a": pa.array([*a, *ids[told]], pa.int64()), "b": pa.array([*b, *nothing], pa.int64()), "docs": pa.array([0] * len(a) + docs[told].tolist(), pa.int64())})


# ---- the join -----------------------------------------------------------------------------------------------------

def candidate_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written (id, set) of the classes in `wanted` (id, least_id, key), from the texts of their first documents."""

    def made(batches):
        for batch in batches:
            rows = [(*key_of(s), len(s), s.tobytes()) for _, s in each_set([batch]) if len(s)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=[*KEY, "set"])

    first = wanted.select(F.col("least_id").alias("first_id")).distinct()
    sets = texts.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").mapInArrow(made, "k1 long, k2 long, n long, set binary")
    return stored(sets.join(wanted.select("id", *KEY), KEY).groupBy("id").agg(F.first("set").alias("set")), "join-sets")


def cluster_links(clusters: DataFrame, classes: DataFrame, sets: DataFrame, block_classes) -> DataFrame:
    """(root, id) of every clustered class -> rows of verify_blocks, each two blocks of a cluster once."""
    members = clusters.join(classes.select("id", "n", "copies"), "id")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_classes), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "id", "block", "copies")
    return met.join(sets, "id").groupBy("root", "one", "two").applyInArrow(verify_blocks, "a long, b long, docs long")


def join(docs: DataFrame, limit=LIMIT, frequent=FREQUENT, block_classes=BLOCK_CLASSES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents that this one links to)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(texts.mapInArrow(described(levels(texts, frequent)), "doc_id long, k1 long, k2 long, n long, signatures binary, sketch binary"), "join-rows")
    grouped = rows.filter("n > 0").groupBy(*KEY).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("signatures").alias("signatures"), F.first("sketch").alias("sketch"))
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "join-classes")
    posted = classes.select("id", "n", "signatures").mapInArrow(lambda b: together(post(b)), "sig long, id long, n long")
    found = stored(posted.repartition("sig").sortWithinPartitions("sig").mapInArrow(pairs_of(limit), "a long, b long, chained boolean"), "join-candidates")
    clusters = stored(components(found.filter("chained").select("a", "b").distinct()).select(F.col("node").alias("id"), "root"), "join-clusters")
    one, two = (clusters.select(F.col("id").alias(c), F.col("root").alias("root_" + c)) for c in "ab")
    pairs = found.filter("not chained").select("a", "b").distinct().join(one, "a", "left").join(two, "b", "left")
    apart = pairs.filter("root_a is null or root_b is null or root_a != root_b").select("a", "b")
    light = classes.select("id", "sketch", F.col("n").alias("m"))
    one, two = (light.select(F.col("id").alias(c), F.col("sketch").alias("sketch_" + c), F.col("m").alias("m_" + c)) for c in "ab")
    sketched = apart.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b", F.expr("m_a + m_b").alias("sizes"))
    pairs = stored(sketched.mapInArrow(screen, "a long, b long"), "join-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(clusters.select("id")).distinct()
    sets = candidate_sets(texts, classes.join(ids, "id").select("id", "least_id", *KEY))
    with_a = pairs.join(sets.withColumnRenamed("id", "a").withColumnRenamed("set", "set_a"), "a")
    with_b = with_a.join(sets.withColumnRenamed("id", "b").withColumnRenamed("set", "set_b"), "b")
    sure = stored(with_b.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long"), "join-links")
    inner = stored(cluster_links(clusters, classes, sets, block_classes), "join-cluster-links")
    copies = classes.select(F.col("id").alias("b"), F.col("copies").alias("docs"))
    both = sure.union(sure.select("b", "a"))
    met = both.join(copies, "b").select("a", "docs").union(inner.filter("b is null").select("a", "docs"))
    links = met.groupBy("a").agg(F.sum("docs").alias("docs")).withColumnRenamed("a", "id")
    roots = components(sure.union(inner.filter("b is not null").select("a", "b"))).select(F.col("node").alias("id"), "root")
    rooted = classes.select("id", "least_id", "copies", *KEY).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(links, "id", "left")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select(*KEY, "component_id", (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"))
    whole = rows.select("doc_id", *KEY).join(named, KEY, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
