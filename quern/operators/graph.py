"""Building and querying the graph of entities and relationships."""

from __future__ import annotations


from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.components import components
from quern.operators.ordered import next_of
from quern.operators.retrieval import bm25
from quern.sources.ontology import weight_of
from quern.tables import materialise

NODE_GATE, EDGE_GATE, NO_CONFIDENCE = 0.60, 0.55, 0.8
MENTION_BLOCK = 200_000
#: Names of a unit that are paired with all its others in one part.
UNIT = 512


def merge_nodes(entities: DataFrame) -> DataFrame:
    """(name, entity_type, confidence, properties, first_document, last_document, mentions): one node of each name and type.

    The confidence is the greatest; a null one counts as none. Properties are
    those of the first mention. Ties in time are broken by document and properties.
    """
    at = F.struct("extracted_at", "document_id", "properties")
    return entities.where("name IS NOT NULL").groupBy("name", "entity_type").agg(F.max("confidence").alias("confidence"), F.min_by("properties", at).alias("properties"), F.min_by("document_id", at).alias("first_document"), F.max_by("document_id", at).alias("last_document"), F.count("*").alias("mentions"))


def merge_edges(relations: DataFrame) -> DataFrame:
    """(from_name, from_type, rel_type, to_name, to_type, document_id, confidence): one edge of each pair, type and document with the greatest confidence."""
    rel = F.coalesce("rel_type", F.lit("RELATED_TO")).alias("rel_type")
    return relations.groupBy("from_name", "from_type", rel, "to_name", "to_type", "document_id").agg(F.max("confidence").alias("confidence"))


def confident_nodes(nodes: DataFrame, least: float = NODE_GATE) -> DataFrame:
    return nodes.where(F.coalesce("confidence", F.lit(NO_CONFIDENCE)) >= least)


def confident_edges(edges: DataFrame, nodes: DataFrame, least: float = EDGE_GATE) -> DataFrame:
    """Edges of enough confidence with both ends, by name whatever their type, among confident nodes."""
    names = confident_nodes(nodes).select("name").distinct()
    ok = edges.where(F.coalesce("confidence", F.lit(NO_CONFIDENCE)) >= least)
    for end in ("from_name", "to_name"):
        ok = ok.join(names.withColumnRenamed("name", end), end, "left_semi")
    return ok


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist with the given type; the others are dropped."""
    n = nodes.select("name", "entity_type").distinct()
    return edges.join(n.withColumnsRenamed({"name": "from_name", "entity_type": "from_type"}), ["from_name", "from_type"], "left_semi").join(n.withColumnsRenamed({"name": "to_name", "entity_type": "to_type"}), ["to_name", "to_type"], "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    """(name, degree): ends of edges, a loop counting twice."""
    return edges.select(F.col("from_name").alias("name")).unionAll(edges.select("to_name")).where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("degree"))


def cooccurrences(mentions: DataFrame, unit: list[str], related: DataFrame) -> DataFrame:
    """(a, b, n, weight): names that share `n` units, a < b, without pairs related already in either direction.

    A unit's names are paired with each other, as the result holds those pairs; a
    unit of many names is spread over tasks.
    """
    m = mentions.where(F.col("name").isNotNull())
    for u in unit:
        m = m.where(F.col(u).isNotNull())
    m = materialise(m.select(*unit, "name").distinct())
    # A large unit is dealt to parts, and each part is paired with the whole unit.
    sizes = m.groupBy(*unit).agg(F.ceil(F.count("*") / UNIT).cast("int").alias("parts"))
    m = m.join(sizes, unit)
    one = m.select(*unit, F.col("name").alias("a"), F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"))
    all_ = m.select(*unit, F.col("name").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = one.join(all_, [*unit, "part"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    known = related.select(F.least("from_name", "to_name").alias("a"), F.greatest("from_name", "to_name").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti").withColumn("weight", F.round(F.least(0.5 + 0.1 * F.col("n"), F.lit(0.85)), 6))


def khop(starts: DataFrame, edges: DataFrame, hops: int = 2, limit: int | None = None) -> DataFrame:
    """(start, node, hops, first_type, path): every trail of 1 to `hops` (at most 4) edges from each start, in either direction.

    `starts` has a column start, `edges` the columns edge_id, a, b and type. A
    trail uses no edge twice; it may meet a node twice, its start included. With
    a `limit`, a start has its first trails only: fewest hops first, then by path.
    """
    hops = min(4, max(1, hops))
    ways = edges.select("edge_id", F.col("a").alias("x"), F.col("b").alias("y"), "type").unionAll(edges.where("a <> b").select("edge_id", F.col("b").alias("x"), F.col("a").alias("y"), "type"))
    level = starts.distinct().join(ways, F.col("start") == F.col("x")).select("start", F.col("y").alias("node"), F.lit(1).alias("hops"), F.col("type").alias("first_type"), F.array("edge_id").alias("path"))
    out = level
    for h in range(2, hops + 1):
        level = level.join(ways, F.col("node") == F.col("x")).where(~F.array_contains("path", F.col("edge_id"))).select("start", F.col("y").alias("node"), F.lit(h).alias("hops"), "first_type", F.array_append("path", F.col("edge_id")).alias("path"))
        out = out.unionByName(level)
    if limit is None:
        return out
    w = Window.partitionBy("start").orderBy("hops", "path")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def neighbourhood(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(start, edge_id, a, type, b): the distinct edges of the trails from each start, in their stored direction.

    Found by frontiers of distinct nodes instead of trails: an edge lies on a trail
    of so many edges if one of its ends is reached with one less. A start
    without edges has one row, of itself and nulls.
    """
    ends = edges.select("edge_id", F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.where("a <> b").select("edge_id", F.col("b").alias("x"), F.col("a").alias("y")))
    front = starts.select("start").distinct().withColumn("x", F.col("start"))
    seen = None
    for h in range(min(4, max(1, hops))):
        step = materialise(front.join(ends, "x").select("start", "edge_id", F.col("y").alias("x")).distinct())
        own = step.select("start", "edge_id")
        seen = own if seen is None else seen.unionByName(own).distinct()
        front = step.select("start", "x").distinct()
    found = materialise(seen.distinct())
    none = F.lit(None).cast("string")
    lone = starts.select("start").distinct().join(found.select("start").distinct(), "start", "left_anti").select("start", none.alias("edge_id"), F.col("start").alias("a"), none.alias("type"), none.alias("b"))
    return found.join(edges, "edge_id").select("start", "edge_id", "a", "type", "b").unionByName(lone)


def structure(documents: DataFrame, chunks: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node_id, label), edges (source, target, type)) of documents, their chunks and elements: a document has chunks, a chunk follows another and is made of elements."""
    d, c = documents.select("document_id").distinct(), chunks.select("document_id", "chunk_key", "chunk_index", "element_uids").distinct()
    node = lambda df, col, label: df.select(F.col(col).alias("node_id"), F.lit(label).alias("label"))
    uid = F.concat_ws(":", "document_id", "element_uid")
    nodes = node(d, "document_id", "Document").unionAll(node(c.select("chunk_key").distinct(), "chunk_key", "Chunk")).unionAll(elements.select(uid.alias("node_id"), F.lit("Element").alias("label")).distinct())
    has = c.select(F.col("document_id").alias("source"), F.col("chunk_key").alias("target"), F.lit("HAS_CHUNK").alias("type")).distinct()
    keyed = c.groupBy("document_id", "chunk_key").agg(F.min("chunk_index").alias("chunk_index"))
    after = next_of(keyed, ["document_id"], "chunk_index", ["chunk_key"], F.col("chunk_key"), "n").where("n IS NOT NULL").select(F.col("chunk_key").alias("source"), F.col("n").alias("target"), F.lit("NEXT").alias("type"))
    made = c.select("document_id", "chunk_key", F.explode("element_uids").alias("element_uid")).select(F.col("chunk_key").alias("source"), uid.alias("target"), F.lit("MADE_OF").alias("type")).distinct()
    return nodes, has.unionAll(after).unionAll(made)


def relation_units(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(edge_id, unit) of all text units (document_id) of either end of an edge (edge_id, a, b), each once; a row each, so no edge gathers a list."""
    own = entities.select("name", F.col("document_id").alias("unit")).where("name IS NOT NULL AND unit IS NOT NULL").distinct()
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("name"))
    return ends.join(own, "name").select("edge_id", "unit").distinct()


def mentions(elements: DataFrame, names: DataFrame, element: str = "element_uid", text: str = "content_text", block: int = MENTION_BLOCK) -> DataFrame:
    """(document_id, `element`, name, match_type): names found in texts, whatever the case.

    A name of up to four characters must stand as a word, a longer one may stand
    anywhere. Names are a stated set taken in blocks; each block is one
    Aho-Corasick automaton, so a text is read once for all of its names. Blank
    names and null texts match nothing.
    """
    spark = elements.sparkSession
    parts = []

    def blocks() -> Iterator[list[str]]:
        held: list[str] = []
        for (n,) in names.select("name").where("name IS NOT NULL").distinct().toLocalIterator():
            if n.strip():
                held.append(n)
            if len(held) == block:
                yield held
                held = []
        if held:
            yield held

    schema = "document_id string, element string, name string, match_type string"
    source = elements.where(F.col(text).isNotNull()).select("document_id", F.col(element).alias("element"), F.col(text).alias("body")).distinct()
    for own in blocks():
        sent = spark.sparkContext.broadcast(own)  # at most `block` names

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            by: dict[str, list[str]] = {}
            for n in sent.value:
                by.setdefault(n.lower(), []).append(n)
            auto = ahocorasick.Automaton()
            for low in by:
                auto.add_word(low, low)
            auto.make_automaton()
            for batch in batches:
                rows = []
                for doc, el, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    s = body.lower()
                    found = set()
                    for end, low in auto.iter(s):
                        if low in found:
                            continue
                        start = end - len(low) + 1
                        if len(low) > 4 or not ((start > 0 and (s[start - 1].isalnum() or s[start - 1] == "_")) or (end + 1 < len(s) and (s[end + 1].isalnum() or s[end + 1] == "_"))):
                            found.add(low)
                    rows += [(doc, el, n, "word_boundary" if len(n) <= 4 else "substring") for low in found for n in by[low]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["document_id", "element", "name", "match_type"])

        parts.append(source.mapInArrow(find, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumnRenamed("element", element)


def _rests(c: Column) -> Column:
    """A text and what is left of it without one or two of its letters."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.left(x, i - 1), F.substring(x, i + 1, F.length(x))))
    one = F.array_distinct(less(c))
    return F.array_distinct(F.concat(F.array(c), one, F.flatten(F.transform(one, lambda x: F.when(F.length(x) > 0, less(x)).otherwise(F.array().cast("array<string>"))))))


#: Names of up to SHORT letters are compared by what two deletions leave of them, names of LONG or more by thirds of them; lengths between take part in both.
SHORT, LONG = 16, 13


def near_names(names: DataFrame, kind: str = "entity_type") -> DataFrame:
    """(`kind`, a, b): all pairs of different names (name, `kind`) of one kind within two edits, both ways.

    Short names within two edits share what is left without two of their letters;
    of a long name's thirds two edits leave one as it was, at most two places
    away. So candidates share long rests, not prefixes that many names have.
    """
    n = names.select(kind, "name").where("name IS NOT NULL AND name <> ''").distinct().withColumn("l", F.length("name"))
    short = n.where(F.col("l") <= SHORT).select(kind, "name", F.explode(F.transform(_rests(F.col("name")), lambda x: F.xxhash64(x))).alias("key")).distinct()
    part = lambda l, k: F.floor(l * k / 3).cast("int")  # noqa: E731, E741
    own = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.xxhash64(k, F.col("l"), F.substring(F.col("name"), part(F.col("l"), k) + 1, part(F.col("l"), k + 1) - part(F.col("l"), k))))
    held = n.where(F.col("l") >= LONG).select(kind, "name", F.explode(own).alias("key"))
    asked = n.where(F.col("l") >= LONG).select(kind, "name", "l", F.explode(F.sequence(F.col("l") - 2, F.col("l") + 2)).alias("m")).select(kind, "name", "m", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("*", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("s"))
    at, size = part(F.col("m"), F.col("k")) + F.col("s") + 1, part(F.col("m"), F.col("k") + 1) - part(F.col("m"), F.col("k"))
    asked = asked.where(at >= 1).select(kind, "name", F.xxhash64("k", "m", F.substring(F.col("name"), at, size)).alias("key")).distinct()
    both = lambda x, y: x.select(kind, F.col("name").alias("a"), "key").join(y.select(kind, F.col("name").alias("b"), "key"), [kind, "key"]).where("a <> b")
    close = both(short, short).unionByName(both(asked, held)).select(kind, "a", "b").distinct()
    close = close.where(F.levenshtein("a", "b", 2) >= 0)
    return close.unionByName(close.select(kind, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def canonicalise(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, entity_type, canonical, how): the canonical name by itself, by alias, by a near spelling, or the name itself.

    `names` (name, entity_type, mentions), `aliases` (alias, canonical). A near
    spelling is the most mentioned name of the same type within two edits, of
    names over five letters, mentioned more often itself.
    """
    n = names.select("name", "entity_type", "mentions").where("name IS NOT NULL")
    exact = n.select("name", "entity_type").join(aliases.select(F.col("canonical").alias("name")).distinct(), "name").select("name", "entity_type", F.col("name").alias("exact")).distinct()
    alias = n.join(aliases, F.col("name") == F.col("alias")).groupBy("name", "entity_type").agg(F.min("canonical").alias("by_alias"))
    long = n.where(F.length("name") > 5)
    close = near_names(long).join(long.withColumnsRenamed({"name": "a", "mentions": "own"}), ["entity_type", "a"]).join(long.withColumnsRenamed({"name": "b", "mentions": "m"}), ["entity_type", "b"]).where("m > own")
    fuzzy = close.groupBy(F.col("a").alias("name"), "entity_type").agg(F.max(F.struct("m", "b")).alias("b")).select("name", "entity_type", F.col("b.b").alias("by_near"))
    out = n.join(exact, ["name", "entity_type"], "left").join(alias, ["name", "entity_type"], "left").join(fuzzy, ["name", "entity_type"], "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_near").isNotNull(), "fuzzy").otherwise("self")
    return out.select("name", "entity_type", F.coalesce("exact", "by_alias", "by_near", "name").alias("canonical"), how.alias("how"))


def describe(name: Column, kind: Column, props: Column) -> Column:
    """A node's description: its type, then its properties in title case, by name."""
    parts = F.array_sort(F.transform(F.map_entries(F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))), lambda x: F.concat(F.initcap(F.replace(x["key"], F.lit("_"), F.lit(" "))), F.lit(": "), x["value"])))
    return F.concat(name, F.lit(" is a "), F.lower(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit("."), F.when(F.size(parts) > 0, F.concat(F.lit(" "), F.array_join(parts, "; "))).otherwise(F.lit("")))


def export_relationships(edges: DataFrame) -> DataFrame:
    """(source, target, rel_type, weight, description) of edges."""
    return edges.select(F.col("from_name").alias("source"), F.col("to_name").alias("target"), "rel_type", weight_of(F.col("rel_type")).alias("weight"), F.concat_ws(" ", "from_name", "rel_type", "to_name").alias("description")).distinct()


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label): synchronous weighted label propagation over edges (a, b, weight), each way.

    In each round a node takes the label of the greatest total weight among its
    neighbours and itself, ties to the smallest; the number of rounds is fixed,
    so the result doesn't depend on partitioning. Labels are counted in each task
    first, a node of high degree isn't gathered.
    """
    ways = materialise(edges.where("a <> b").select("a", "b", "weight").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    labels = materialise(nodes.select("node").distinct().withColumn("label", F.col("node")))
    for r in range(rounds):
        votes = ways.join(labels.withColumnsRenamed({"node": "b"}), "b").select(F.col("a").alias("node"), "label", "weight").unionByName(labels.select("node", "label", F.lit(0.5).alias("weight")))
        total = votes.groupBy("node", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = total.groupBy("node").agg(F.max("w").alias("top"))
        # Another half of the nodes, by hash, moves in each round, so that pairs don't swap labels for ever.
        moving = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        chosen = total.join(best, "node").where("w = top").groupBy("node").agg(F.min("label").alias("next"))
        labels = materialise(labels.join(chosen, "node").select("node", F.when(moving, F.col("next")).otherwise(F.col("label")).alias("label")))
    return labels


def communities(nodes: DataFrame, edges: DataFrame, most: int = 10, rounds: tuple[int, ...] = (8, 2)) -> DataFrame:
    """(node, level, community, parent, size): a hierarchy of communities, named by their smallest node.

    Level 0 are the connected components. Each further level parts the communities
    of over `most` nodes of the level above by label propagation within them, with
    fewer rounds each time, so with smaller parts; smaller communities end there.
    Nodes without edges are alone.
    """
    every = nodes.select("node").distinct()
    own = materialise(components(every, edges.select("a", "b")).withColumnRenamed("component", "community"))
    own = own.join(own.groupBy("community").agg(F.count("*").alias("size")), "community").select("node", F.lit(0).alias("level"), "community", F.lit(None).cast("string").alias("parent"), "size")
    out = above = materialise(own)
    for level, n in enumerate(rounds, 1):
        big = above.where(F.col("size") > most).select("node", F.col("community").alias("parent"))
        if not big.take(1):
            break
        inside = edges.join(big.select(F.col("node").alias("a"), F.col("parent").alias("p")), "a").join(big.select(F.col("node").alias("b"), F.col("parent").alias("q")), "b").where("p = q").select("a", "b", "weight")
        part = big.join(propagate(big, inside, n), "node")
        names = part.groupBy("label").agg(F.min("node").alias("community"), F.count("*").alias("size"))
        above = materialise(part.join(names, "label").select("node", F.lit(level).alias("level"), "community", "parent", "size"))
        out = out.unionByName(above)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of edges (a, b)."""
    return edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).groupBy("node").agg(F.count("*").alias("degree"))


def reports(members: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """(community, size, report): the members (node, community, size) of highest degree and the number of relations within, in place of a written report."""
    inside = edges.join(members.select(F.col("node").alias("a"), F.col("community")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("c")), "b").where("community = c").groupBy("community").agg(F.count("*").alias("relations"))
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    first = members.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    text = first.groupBy("community", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]), ", ").alias("names"))
    return text.join(inside, "community", "left").select("community", "size", F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" around "), "names", F.lit(" with "), F.coalesce("relations", F.lit(0)).cast("string"), F.lit(" relations.")).alias("report"))


def _described(members: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(entity, community, degree, neighbours): each member with its degree and first neighbours by name."""
    near = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a")).where("node <> other").distinct()
    w = Window.partitionBy("node").orderBy("other")
    first = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("neighbours"))
    return members.select("node", "community").join(degrees(edges), "node", "left").join(first, "node", "left").select(F.col("node").alias("entity"), "community", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def local_search(queries: DataFrame, members: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(qid, rank, entity, degree, neighbours, community, report): the entities that a query's text (qid, text) names, those of highest degree first, with what is known around them."""
    asked = queries.select(F.lit("").alias("document_id"), F.col("qid").cast("string").alias("q"), "text")
    named = mentions(asked, members.select(F.col("node").alias("name")), "q", "text").select("q", F.col("name").alias("entity"))
    found = named.join(_described(members, edges), "entity")
    w = Window.partitionBy("q").orderBy(F.desc("degree"), "entity")
    cut = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return cut.join(reports(members, edges).select("community", "report"), "community").select(F.col("q").alias("qid"), "rank", "entity", "degree", "neighbours", "community", "report")


def global_search(queries: DataFrame, members: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(qid, rank, community, score, size, report): the reports that fit each query (qid, text) best by BM25: the map step of a global search, cut and ordered."""
    written = materialise(reports(members, edges))
    found = bm25(written.select(F.col("community").alias("id"), F.col("report").alias("text")), queries, top)
    return found.join(written.withColumnRenamed("community", "id"), "id").select("qid", "rank", F.col("id").alias("community"), "score", "size", "report")


def drift_search(queries: DataFrame, members: DataFrame, edges: DataFrame, top: int = 10, primer: int = 3) -> DataFrame:
    """(qid, rank, entity, degree, neighbours, community, score): from the best reports of each query on to their entities: by the report's score, then by degree."""
    best = global_search(queries, members, edges, primer).select("qid", "community", "score")
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "entity")
    heads = _described(members, edges).withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("degree"), "entity")
    return best.join(heads, "community").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("qid", "rank", "entity", "degree", "neighbours", "community", "score")
