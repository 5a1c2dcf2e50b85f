"""Documents whose shingle sets are similar, by a token-group matrix: groups of documents are opened only where their tokens allow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import components, grouped
from .shared import discard, slices, stored
from .shingles import shingle_sets

#: Most documents and about the most tokens of a group, and queries of a group that one task answers.
MEMBERS, TOKENS, QUERIES = 256, 1 << 18, 1024


def required(n: Column, percent: int) -> Column:
    """Tokens that a set of n has in common with any similar set, at least."""
    return F.ceil(n * percent / 100).cast("long") if isinstance(n, Column) else -(-n * percent // 100)


def spare(n, percent: int):
    """Tokens beyond the shortest prefix that are read, and so the matches that a similar set has in the prefix."""
    least = n * (100 - percent) // 100 if not isinstance(n, Column) else F.floor(n * (100 - percent) / 100).cast("long")
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.least(least, required(n, percent)))
    return max(1, min(least, required(n, percent)))


def prefixes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (hash of the text), node (of the shingle set; null if empty), n (its size), least (its smallest hash), prefix.

    prefix holds the smallest hashes: as many as leave out required(n) - spare(n). Sets that a task has just met come without it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        np.seterr(over="ignore")
        seen: set[int] = set()
        for part in slices(batches, "text"):
            nodes, sizes, least, cuts = [], [], [], []
            for s in shingle_sets(part.column(2).to_pylist(), width):
                n = len(s)
                node = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if n else None
                known = node is None or node in seen
                nodes.append(node)
                sizes.append(n)
                least.append(int(s[:1].view("i8")[0]) if n else None)
                cuts.append(None if known else s[: n - required(n, percent) + spare(n, percent)].view("i8"))
                if not known:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in (nodes, sizes, least)), pa.array(cuts, pa.list_(pa.int64()))], names=["doc_id", "t", "node", "n", "least", "prefix"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, node long, n long, least long, prefix array<long>")


def first_sieve(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """node: sets with enough prefix tokens that another set's prefix has, too.

    Similar sets share required(n) tokens, of which at most required(n) - spare(n) are behind a prefix. What is left is the least of
    spare() of both; the other set has required(n) tokens or more.
    """
    tokens = rows.where("prefix is not null").select("node", F.explode("prefix").alias("token"))
    shared = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token"), "tokens")
    met = tokens.join(shared, "token", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    out = stored(met.join(nodes.select("node", "n"), "node").where(F.col("m") >= spare(required(F.col("n"), percent), percent)).select("node"), "survivors")
    discard(shared)
    return out


def full_sets(docs: DataFrame, nodes: DataFrame, survivors: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, n, least, tokens (the whole set, sorted) of the survivors, from the text of each one's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        np.seterr(over="ignore")
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column(3).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))], names=["node", "n", "least", "tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_t"), text.cast("binary").alias("text"))
    wanted = nodes.join(survivors, "node")
    found = texts.join(wanted, (F.col("_t") == F.col("t")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "n", "least", "text")
    return found.mapInArrow(run, "node long, n long, least long, tokens array<long>")


def second_sieve(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, least, probes: of each set's n - required(n) + 1 rarest tokens those that another set has; sets without any go.

    Only survivors count, as any similar set is one. Of the common tokens the rarest is among the probes of both sets.
    """
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    often = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "tokens")
    ranked = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("m", "token"))).alias("k"))
    rare = F.col("n") - required(F.col("n"), percent) + 1
    alone = F.col("n") - F.size("k")
    probes = F.transform(F.slice("k", F.lit(1), F.greatest(F.lit(0), rare - alone).cast("int")), lambda e: e["token"])
    out = stored(sets.select("node", "n", "least").join(ranked, "node").select("node", "n", "least", probes.alias("probes")).where(F.size("probes") > 0), "probes")
    discard(often)
    return out


def with_groups(probes: DataFrame) -> DataFrame:
    """probes with `group`: sets with the same least hash, which similar ones mostly have, in blocks of bounded size."""
    sizes = probes.groupBy("least").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("m") / MEMBERS), F.ceil(F.col("tokens") / TOKENS))
    return probes.join(sizes, "least").select("node", "n", "probes", F.xxhash64("least", F.pmod(F.xxhash64("node"), blocks)).alias("group"))


def settled(links: DataFrame, probes: DataFrame, name: str) -> DataFrame:
    """node, comp of all nodes of probes, by the links found so far."""
    found = components(links, name)
    return stored(probes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("comp")), "comps")


def star_links(probes: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between one set of each component that has a token and the token's first set. No token makes more rows than it has."""
    rows = probes.select("node", F.explode("probes").alias("token")).join(comps, "node")
    each = rows.groupBy("token", "comp").agg(F.min("node").alias("a"))
    first = each.groupBy("token").agg(F.min_by("a", "comp").alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = each.join(first, "token").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    sizes = sets.select("node", "n")
    near = pairs.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b").where((100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n")))
    both = near.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def opened(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components that the token-group matrix allows; enough of them to join what similar sets join.

    The matrix has a row for each token and group: tokens that are probes of a member, with the largest component and the sizes of
    the members that have it. A set asks the groups that share a probe with it and hold a larger component than its own, so that of
    two components the smaller asks. A shared probe counts only if enough tokens are left from it on: if it is the rarest common
    one, no more can be common (`left`, of the set and the most of a member), and similar sets share percent / (100 + percent) of
    both sizes. In the group the set meets the union of all members' tokens, and only if that has required(n) of its own is the
    group opened and compared set by set.
    """
    sized = comps.join(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "comp")
    placed = members.select("node", "n", "group", F.size("probes").alias("k"), F.posexplode("probes").alias("i", "token"))
    left = required(F.col("n"), percent) - 1 + F.col("k") - F.col("i")
    rows = placed.withColumn("left", left).join(sized, "node").select("token", "node", "n", "left", "group", F.struct("size", "comp").alias("own"))
    several = rows.groupBy("token").agg(F.min("own.comp").alias("x"), F.max("own.comp").alias("y")).where("x <> y").select("token")
    rows = rows.join(several, "token", "left_semi")
    matrix = rows.groupBy("token", F.col("group").alias("to")).agg(F.max("own").alias("theirs"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("left").alias("most_left"))
    sizes = (100 * F.col("most_n") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least_n"))
    enough = (100 + percent) * F.least("left", "most_left") >= percent * (F.col("n") + F.col("least_n"))
    asked = stored(rows.drop("group").join(matrix, "token").where((F.col("own") < F.col("theirs")) & sizes & enough).select("node", "to").distinct(), "asked")
    salts = asked.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
    part = lambda salt: F.xxhash64("to", salt).alias("part")
    told = comps.join(sets, "node")
    queries = asked.join(salts, "to").select("node", part(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))
    queries = queries.join(told, "node").select("part", F.lit(True).alias("asks"), "node", "n", "comp", "tokens")
    held = members.select("node", F.col("group").alias("to")).join(salts, "to").select("node", "to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    held = held.select("node", part(F.col("salt"))).join(told, "node").select("part", F.lit(False).alias("asks"), "node", "n", "comp", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for group in grouped(batches, "part"):
            asks, n = group.column("asks").to_numpy(), group.column("n").to_numpy()
            node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
            tokens = group.column("tokens").combine_chunks()
            flat, edges = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            of = lambda k: flat[edges[k] : edges[k + 1]].view("u8")  # noqa: B023, E731
            mine = np.flatnonzero(~asks)
            if not len(mine) or not asks.any():
                continue
            union = np.unique(np.concatenate([of(k) for k in mine.tolist()]))
            home: dict[int, int] = {}

            def root(c, home=home):
                while home.get(c, c) != c:
                    c = home[c]
                return c

            found = []
            for q in np.flatnonzero(asks).tolist():
                own = of(q)
                within = int((union[np.minimum(np.searchsorted(union, own), len(union) - 1)] == own).sum())
                if 100 * within < percent * n[q]:
                    continue  # the group stays closed
                fits = mine[(100 * n[mine] >= percent * n[q]) & (100 * n[q] >= percent * n[mine])]
                for k in fits.tolist():
                    if root(int(comp[q])) == root(int(comp[k])):
                        continue
                    other = of(k)
                    both = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    if 100 * both >= percent * (n[q] + n[k] - both):
                        home[root(int(comp[q]))] = root(int(comp[k]))
                        found.append((int(node[q]), int(node[k])))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return queries.union(held).repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, *, width: int = 5, percent: int = 80, star_rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    A document's set holds its `width`-word shingles (A-Z in lower case; words are runs without 0x20 and 0x09 to 0x0D), as 64-bit
    hashes; with fewer words its whole sequence. Documents are linked where 100 * intersection >= percent * union (percent at least
    50), and component_id is the least doc_id that links reach. No link is lost but by equal hashes of different shingles.

    Documents of one set are one node. Two sieves leave the sets that share enough of their tokens with others: by the smallest
    hashes, then by the rarest tokens. What they share is linked in `star_rounds` rounds to one set for each token, which settles
    groups of near copies in rows that grow with their number. All links between what are then still different components are
    looked for in the token-group matrix: see opened().

    Null and empty texts, and texts without words, have an empty set and link with nothing. Null ids are no component_id unless a
    component has no other. Rows that share an id and a set share a result. Other columns are ignored; an empty table gives no rows.
    Stored tables are deleted once they are read, but for those that the result reads.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    rows = stored(prefixes(docs, width, percent, id_col, text_col), "prefixes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t"))
    by_node = rows.where("node is not null").groupBy("node").agg(first.alias("f"), F.first("n").alias("n"), F.first("least").alias("least"))
    nodes = stored(by_node.select("node", "f.doc_id", "f.t", "n", "least"), "nodes")
    survivors = first_sieve(rows, nodes, percent)
    out = stored(rows.select("doc_id", "node", "n"), "documents")
    discard(rows)
    sets = stored(full_sets(docs, nodes, survivors, width, id_col, text_col).dropDuplicates(["node"]), "sets")
    probes = second_sieve(sets, percent)
    discard(survivors)
    links = None
    comps = probes.select("node", F.col("node").alias("comp"))
    for _ in range(star_rounds):
        more = stored(star_links(probes, comps, sets, percent), "links")
        links = more if links is None else links.union(more)
        comps = settled(links, probes, "components")
    last = stored(opened(with_groups(probes), comps, sets, percent), "links")
    discard(sets)
    linked = components(last if links is None else links.union(last), "components")
    least = linked.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    moved = linked.join(least, "root").select("node", "component_id")
    by_set = nodes.select("node", F.col("doc_id").alias("first_id")).join(moved, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    return out.join(by_set, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
