"""Entity resolution, merges, duplicate entities, near-duplicate content."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.columns import display_key, normalize_alias, significant_tokens
from ..sources.stage import cut
from .graph import chased, live
from .nearest import build, search

#: Least letters of a token that tells names apart, ratios of similar spellings, neighbours of a sure pair.
LEAST_TOKEN, FUZZY, FUZZY_HIGH, HIGH_SHARED = 4, 0.82, 0.92, 2
ENTITY_TYPES = ["person", "place", "topic", "event", "project"]


def surfaces(nodes: DataFrame) -> DataFrame:
    """(id, type, form): every normalised title and alias of live entities, once each."""
    forms = F.explode(F.array_distinct(F.transform(F.concat(F.array("title"), "aliases"), display_key)))
    return live(nodes).where(F.col("type").isin(ENTITY_TYPES)).select("id", "type", forms.alias("form")).where("form <> ''")


def exact_matches(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention, type, id) of entities that bear the mention's name; mentions have (mention, type)."""
    m = mentions.select("mention", "type", display_key(F.col("mention")).alias("form"))
    return m.join(surfaces(nodes), ["type", "form"]).select("mention", "type", "id").distinct()


def token_matches(nodes: DataFrame, mentions: DataFrame, most: int = 100) -> DataFrame:
    """(mention, type, id, is_exact, n): entities with the mention's name or a significant token of it, exact ones
    first, then by title, ``most`` a mention.

    That order does not depend on the mention, so a token's first ``most`` entities are all that can count: a word that
    every name has costs ``most`` rows a mention, not the square of the table.
    """
    title = nodes.select("id", "title")
    t = surfaces(nodes).select("id", "type", F.explode(significant_tokens(F.col("form"))).alias("token")).distinct().join(title, "id")
    t = first_by(t, ["type", "token"], ["title", "id"], most).select("type", "token", "id")
    m = mentions.select("mention", "type", F.explode(significant_tokens(F.col("mention"))).alias("token")).distinct()
    exact = exact_matches(nodes, mentions).withColumn("is_exact", F.lit(True))
    every = m.join(t, ["type", "token"]).select("mention", "type", "id", F.lit(False).alias("is_exact")).union(exact)
    every = every.groupBy("mention", "type", "id").agg(F.max("is_exact").alias("is_exact")).join(title, "id")
    w = Window.partitionBy("mention", "type").orderBy(F.desc("is_exact"), "title", "id")
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("mention", "type", "id", "is_exact", F.col("n").cast("long").alias("n"))


def decide(nodes: DataFrame, mentions: DataFrame, most: int = 100) -> DataFrame:
    """(mention, type, candidates, exact, outcome): mint without candidates, link to a single exact one, else review;
    candidates are the exact ones and those of :func:`token_matches`.

    They are counted and not listed: a token that ``most`` entities have is enough by itself, and only mentions without such a
    one meet their tokens' entities, once for all mentions of the same tokens, and look their exact ones up among them.
    """
    mentions = mentions.select("mention", "type", F.array_sort(F.array_distinct(significant_tokens(F.col("mention")))).alias("tokens")).distinct()
    sets = mentions.select("type", "tokens").distinct().select("type", "tokens", F.explode("tokens").alias("token"))
    t = surfaces(nodes).select("id", "type", F.explode(significant_tokens(F.col("form"))).alias("token")).distinct().join(nodes.select("id", "title"), "id")
    t = cut(first_by(t, ["type", "token"], ["title", "id"], most).select("type", "token", "id"))
    often = t.groupBy("type", "token").agg((F.count("*") >= most).alias("often"))
    sets = cut(sets.join(often, ["type", "token"]).withColumn("enough", F.max("often").over(Window.partitionBy("type", "tokens"))))
    near = cut(sets.where("not enough").join(t, ["type", "token"]).select("type", "tokens", "id").distinct())
    enough = sets.where("enough").select("type", "tokens", F.lit(most).alias("enough")).distinct()
    exact = exact_matches(nodes, mentions).join(mentions, ["mention", "type"])
    held = exact.join(near.withColumn("held", F.lit(1)), ["type", "tokens", "id"], "left")
    e = held.groupBy("mention", "type").agg(F.count("*").alias("exact"), F.min("id").alias("only"), F.count("held").alias("held"))
    n = near.groupBy("type", "tokens").agg(F.count("*").alias("near"))
    out = mentions.join(e, ["mention", "type"], "left").join(n, ["type", "tokens"], "left").join(enough, ["type", "tokens"], "left")
    x = F.coalesce("exact", F.lit(0))
    every = F.coalesce("enough", x + F.coalesce("near", F.lit(0)) - F.coalesce("held", F.lit(0)))
    out = out.withColumn("candidates", F.greatest(x, F.least(every, F.lit(most))))  # exact ones come first and all count
    return out.select("mention", "type", "candidates", x.alias("exact"), F.when(F.col("candidates") == 0, "mint").when(x == 1, F.concat(F.lit("link:"), "only")).otherwise("review").alias("outcome"))


def _identity(nodes: DataFrame) -> DataFrame:
    """(id, key): type and sorted surface forms, joined by characters that no form can hold."""
    forms = surfaces(nodes).groupBy("id", "type").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    return forms.select("id", F.concat("type", F.lit("\x00"), F.array_join("forms", "\x01")).alias("key"))


def loser_keys(nodes: DataFrame) -> DataFrame:
    """(id, key): a merge decision's key, from type and sorted surface forms and not from ids."""
    return _identity(nodes)


def keep_keys(nodes: DataFrame) -> DataFrame:
    """(id, key): the same for a decision to keep, fit for an address."""
    return _identity(nodes).select("id", F.rtrim(F.translate(F.base64(F.encode("key", "UTF-8")), "+/", "-_"), F.lit("=")).alias("key"))


def merge_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges (loser, survivor): inbound ones move with all their columns, the loser's own go, loops and
    doubles of (src, dst, rel, origin) are dropped, the earliest staying.  ``merges`` is free of chains."""
    m = merges.select("loser", "survivor")
    kept = edges.join(m, edges.src == m.loser, "left_anti")
    moved = kept.join(m, kept.dst == m.loser, "left").withColumn("dst", F.coalesce("survivor", "dst")).drop("loser", "survivor").where("src <> dst")
    return first_by(moved, ["src", "dst", "rel", "origin"], [F.asc_nulls_last("since"), F.asc_nulls_last("until")])


def final_survivors(merges: DataFrame, most: int = 32) -> DataFrame:
    """(loser, survivor) with chains of merges followed to their end by doubling; a ring has no end and stops after
    ``most`` steps or more."""
    top = chased(merges.select(F.col("loser").alias("node"), F.col("survivor").alias("up")), max(1, (most - 1).bit_length()))
    return top.select(F.col("node").alias("loser"), F.col("top").alias("survivor"))


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other): canonical neighbours that are live, both ways, once each; loops count once."""
    canon = edges.where("origin = 'canonical'").select("src", "dst")
    both = canon.union(canon.select(F.col("dst"), F.col("src"))).toDF("id", "other").distinct()
    return both.join(live(nodes).select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")


def name_candidates(nodes: DataFrame, links: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """(a, b) of one type, a before b, whose names may match: pairs that one of two keys brings together, and with
    ``links`` a neighbour at once, so that neither a frequent name nor a hub alone does.

    A form whose tokens are a subset of another's has its rarest token there, so every form is looked up by that one
    token among all.  Similar spellings have most letters in common (:func:`spelled_candidates`).
    ``forms`` are the nodes' :func:`surfaces` where they are at hand.
    """
    forms = surfaces(nodes) if forms is None else forms

    def met(parts: DataFrame) -> DataFrame:
        often = parts.groupBy("type", "key").agg(F.count("*").alias("often"), (F.min("id") != F.max("id")).alias("several"))
        rare = first_by(parts.join(often, ["type", "key"]), ["id", "type", "form"], ["often", "key"])
        x = rare.where("several").select("id", "type", "key").distinct()  # a token of one entity alone brings no one together
        y = parts.select("id", "type", "key").distinct().join(x.select("type", "key").distinct(), ["type", "key"], "left_semi")
        on = ["type", "key"]
        if links is not None:
            x, y, on = x.join(links, "id"), y.join(links, "id"), [*on, "other"]
        pairs = x.withColumnRenamed("id", "x").join(y.withColumnRenamed("id", "y"), on)
        return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    words = forms.select("id", "type", "form", F.explode(F.array_distinct(F.split("form", " "))).alias("key"))
    return met(words).union(spelled_candidates(forms, links)).distinct()


def letters(form: str) -> Column:
    """A form's letters as a set: the first a, the second a, ..."""
    every = F.split(form, "")
    return F.flatten(F.transform(F.array_distinct(every), lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(every, lambda x: x == c))), lambda k: F.concat(c, k.cast("string")))))


def spelled_candidates(forms: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(a, b) of one type, a before b, with forms whose ratio can reach ``FUZZY``; no such pair is missed.

    A ratio is at most twice the common letters over the summed lengths, so a pair needs ``FUZZY``/2 of both lengths in
    common.  Of two sets with so many common letters, ordered by rarity, the first few of each (what is not needed, and
    one more) share one; those bring pairs together, with ``links`` only beside a common neighbour, and the bound
    itself is checked before any ratio is.
    """
    half = FUZZY / 2
    rows = forms.where(F.length("form") >= LEAST_TOKEN).select("id", "type", "form", letters("form").alias("bag"))
    each = rows.select("id", "type", "form", F.explode("bag").alias("key"))
    often = each.groupBy("type", "key").agg(F.count("*").alias("often"))
    need = F.ceil(F.lit(half) * (F.length("form") + F.ceil(F.length("form") * (half / (1 - half)) - 1e-9)) - 1e-9)
    w = Window.partitionBy("id", "type", "form").orderBy("often", "key")
    rare = each.join(often, ["type", "key"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.length("form") - need + 1)
    x = rare.select("id", "type", "form", "key")
    on = ["type", "key"]
    if links is not None:
        x, on = x.join(links, "id"), [*on, "other"]
    y = x.withColumnRenamed("id", "b").withColumnRenamed("form", "b_form")
    pairs = x.withColumnRenamed("id", "a").withColumnRenamed("form", "a_form").join(y, on).where("a < b").select("a", "b", "type", "a_form", "b_form").distinct()
    near = F.size(F.array_intersect(letters("a_form"), letters("b_form"))) >= F.lit(half) * (F.length("a_form") + F.length("b_form")) - 1e-9
    return pairs.where(near).select("a", "b").distinct()


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("score", DoubleType())]))
def name_match(a_forms: pd.Series, b_forms: pd.Series) -> pd.DataFrame:
    """How two lists of forms match: ``exact`` or ``containment`` of token sets, else ``fuzzy``; null kind for neither."""
    out = []
    for xs, ys in zip(a_forms, b_forms, strict=True):
        best: tuple[str | None, float] = (None, 0.0)
        sets = [(set(x.split()), set(y.split())) for x in xs for y in ys]
        shares = [min(len(p), len(q)) / max(len(p), len(q)) for p, q in sets if p and q and (p <= q or q <= p) and any(len(t) >= LEAST_TOKEN for t in p & q)]
        if shares:
            best = ("exact" if max(shares) == 1.0 else "containment", max(shares))
        else:
            ratio = max((SequenceMatcher(None, x, y).ratio() for x in xs for y in ys if min(len(x), len(y)) >= LEAST_TOKEN), default=0.0)
            if ratio >= FUZZY:
                best = ("fuzzy", ratio)
        out.append(best)
    return pd.DataFrame(out, columns=["kind", "score"])


def shared_neighbours(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard) of pairs with neighbours in common, the two themselves not counted."""
    x, y = links.select(F.col("id").alias("a"), "other"), links.select(F.col("id").alias("b"), "other")
    common = pairs.select("a", "b").join(x, "a").join(y, ["b", "other"]).where("other <> a and other <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = links.groupBy("id").agg(F.count("*").alias("n"))
    direct = links.select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(2).alias("own"))
    out = common.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").join(direct, ["a", "b"], "left")
    rest = F.col("na") + F.col("nb") - F.col("shared") - F.coalesce("own", F.lit(0))
    return out.select("a", "b", "shared", (F.col("shared") / rest).alias("jaccard"))


def name_sets(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, set) and (p, q, score), both written: which token sets entities bear, and which sets lie in which, with a token that
    tells names apart; a set lies in itself.  Two entities match if one bears a set in which one of the other's lies.

    What matches is found between distinct sets, however many bear one: a set is looked up by its rarest token among all.
    Sets that match no other and have one bearer are left out.
    """
    borne = forms.select("id", "type", F.array_sort(F.array_distinct(F.split("form", " "))).alias("tokens")).distinct()
    sets = cut(borne.groupBy("type", "tokens").agg(F.count("*").alias("bearers")).withColumn("set", F.monotonically_increasing_id()))
    telling = F.exists("tokens", lambda t: F.length(t) >= LEAST_TOKEN)
    words = sets.select("type", "set", "tokens", telling.alias("telling"), F.explode("tokens").alias("token"))
    often = words.groupBy("type", "token").agg(F.count("*").alias("often")).where("often > 1")
    rare = first_by(words.where("telling").join(often, ["type", "token"]), ["set"], ["often", "token"])
    # a set with a token of its own is in no other, which the inner join above tells by a lesser count of tokens
    whole = words.where("telling").join(often, ["type", "token"], "left_semi").groupBy("set").agg(F.count("*").alias("met"))
    rare = rare.join(whole, "set").where(F.col("met") == F.size("tokens"))
    p, q = rare.select("type", "token", F.col("set").alias("p"), F.col("tokens").alias("inner")), words.select("type", "token", F.col("set").alias("q"), F.col("tokens").alias("outer"))
    inside = (F.size("inner") < F.size("outer")) & (F.size(F.array_except("inner", "outer")) == 0)
    proper = cut(p.join(q, ["type", "token"]).where(inside).select("p", "q", (F.size("inner") / F.size("outer")).alias("score")))
    used = proper.select(F.explode(F.array("p", "q")).alias("set")).union(sets.where(telling & (F.col("bearers") > 1)).select("set")).distinct()
    pairs = cut(proper.union(used.select("set", F.col("set").alias("q"), F.lit(1.0))))
    own = borne.join(sets.join(pairs.where("p = q").select(F.col("p").alias("set")), "set", "left_semi").select("type", "tokens", "set"), ["type", "tokens"])
    return cut(own.select("id", "set")), pairs


def set_pairs(forms: DataFrame) -> DataFrame:
    """(a, b, kind, score), a before b, of entities whose token sets match, by the best match.

    Entities with the same sets are one class; classes are matched, and each two members of matching ones are a row, which
    no shuffle sees: the result grows with the square of like names, what is done for it does not.
    """
    own, pairs = name_sets(forms)
    bundles = own.groupBy("id").agg(F.array_sort(F.collect_list("set")).alias("sets"))
    classes = cut(bundles.select("sets").distinct().withColumn("class", F.monotonically_increasing_id()))
    members = cut(bundles.join(classes, "sets").select("id", "class"))
    held = classes.select("class", F.explode("sets").alias("set"))
    met = pairs.join(held.toDF("x", "p"), "p").join(held.toDF("y", "q"), "q")
    met = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("score").alias("score"))
    met = met.join(members.toDF("xid", "x"), "x").repartition("y", "xid").join(members.toDF("yid", "y"), "y").where("x <> y or xid < yid")
    return met.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b"), _kind(), "score")


def _kind() -> Column:
    return F.when(F.col("score") == 1, "exact").otherwise("containment").alias("kind")


def linked_pairs(forms: DataFrame, links: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """(a, b, kind, score, shared), a before b: entities whose token sets match and that have neighbours in common, the two
    themselves not counted.  ``links`` (id, other) may have doubles; with ``alive`` (id) only such neighbours count.

    Two entities meet at a neighbour by a matching set, so neither a name nor a hub brings a pair together alone, and a
    pair's rows are as many as its common neighbours.
    """
    own, pairs = name_sets(forms)
    reach = cut(own.withColumnRenamed("set", "p").join(pairs, "p").groupBy("id", F.col("q").alias("set")).agg(F.max("score").alias("score")))
    at = cut(links.where("id <> other").join(reach, "id").select("other", "set", "id", "score"))
    full = at.where("score = 1").select("other", "set", F.col("id").alias("x"))
    met = full.join(at.withColumnRenamed("id", "y"), ["other", "set"]).where("if(score < 1, x <> y, x < y)")
    met = met.select("other", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    met = met if alive is None else met.join(alive.select(F.col("id").alias("other")), "other", "left_semi")
    met = met.repartition("a", "b").groupBy("a", "b", "other").agg(F.max("score").alias("score"))  # the next count needs no shuffle
    return met.groupBy("a", "b").agg(F.max("score").alias("score"), F.count("*").alias("shared")).select("a", "b", _kind(), "score", "shared")


def with_jaccard(pairs: DataFrame, degrees: DataFrame, direct: DataFrame) -> DataFrame:
    """``pairs`` (a, b, shared) with the share of common neighbours among both's, the two themselves not counted; ``degrees``
    are (id, degree), ``direct`` the links (id, other) between entities, which may have doubles."""
    n = degrees.select("id", "degree")
    own = direct.select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(2).alias("own")).distinct()
    out = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").join(own, ["a", "b"], "left")
    rest = F.col("na") + F.col("nb") - F.col("shared") - F.coalesce("own", F.lit(0))
    return out.select(*pairs.columns, (F.col("shared") / rest).alias("jaccard"))


def named_pairs(nodes: DataFrame, links: DataFrame | None = None, spelling: bool = True, forms: DataFrame | None = None) -> DataFrame:
    """(a, b, kind, score): candidates that pass the name gate; by token sets alone, linked or not, without ``spelling``."""
    borne = surfaces(nodes) if forms is None else forms
    if not spelling:
        return set_pairs(borne)
    forms = borne.groupBy("id").agg(F.collect_list("form").alias("forms"))
    rows = name_candidates(nodes, links, borne).join(forms.toDF("a", "xs"), "a").join(forms.toDF("b", "ys"), "b").withColumn("m", name_match("xs", "ys"))
    return rows.select("a", "b", "m.kind", "m.score").where("kind is not null")


def duplicate_pairs(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, kind, score, shared, jaccard, high): entities with matching names and a neighbour in common; ``high`` for
    strong names with two or more.  The names, the links and the matching pairs are each written once and read by the joins."""
    forms, links = cut(surfaces(nodes)), cut(links)
    named = cut(named_pairs(nodes, links, forms=forms))
    strong = F.col("kind").isin("exact", "containment") | (F.col("score") >= FUZZY_HIGH)
    return named.join(shared_neighbours(named, links), ["a", "b"]).withColumn("high", (F.col("shared") >= HIGH_SHARED) & strong)


def ranked_pairs(pairs: DataFrame, filed: DataFrame, most: int = 200) -> DataFrame:
    """The best ``most`` pairs that are not in ``filed`` (a, b): high ones, more neighbours, better names first."""
    return pairs.join(filed.select("a", "b"), ["a", "b"], "left_anti").orderBy(F.desc("high"), F.desc("shared"), F.desc("score"), F.desc("a"), F.desc("b")).limit(most)


def survivors(pairs: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(a, b, survivor): the better connected one, else the older, else the smaller id."""
    d = nodes.join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "created_on")
    x, y = d.toDF("a", "da", "ca"), d.toDF("b", "db", "cb")
    first = F.when(F.col("da") != F.col("db"), F.col("da") > F.col("db")).when(F.col("ca") != F.col("cb"), F.col("ca") < F.col("cb")).otherwise(F.col("a") < F.col("b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("survivor"))


def canonical_pairs(found: DataFrame) -> DataFrame:
    """Directed (id, other, score) as one row a pair, the best sighting."""
    both = found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "score")
    return both.groupBy("a", "b").agg(F.max("score").alias("score"))


def content_candidates(points: DataFrame, nodes: DataFrame, edges: DataFrame, since: Column, k: int, floor: float) -> DataFrame:
    """(a, b, cosine, overlap, shared): live content ``points`` (id, embedding) indexed since a day, beside their ``k``
    nearest of at least ``floor``, where both have a canonical edge to a common live entity (``shared``, sorted) and,
    if both are dated, their times meet (``overlap``)."""
    own = live(nodes).select("id", "occurred_start", F.coalesce("occurred_end", "occurred_start").alias("occurred_end"), "indexed_on")
    points = points.join(own.select("id"), "id", "left_semi")
    recent = points.join(own.where(F.col("indexed_on") >= since), "id", "left_semi")
    near = cut(search(build(points, k + 2), recent, k, floor).toDF("a", "b", "cosine"))
    x, y = own.select("id", "occurred_start", "occurred_end").toDF("a", "xs", "xe"), own.select("id", "occurred_start", "occurred_end").toDF("b", "ys", "ye")
    meet = (F.col("xs") <= F.col("ye")) & (F.col("ys") <= F.col("xe"))
    met = near.join(x, "a").join(y, "b").withColumn("meet", meet).where("meet or meet is null")
    canon = edges.where("origin = 'canonical'").select("src", "dst")
    hubs = live(nodes).where(F.col("type").isin(ENTITY_TYPES)).select(F.col("id").alias("hub"))
    shared = near.select("a", "b").join(canon.toDF("a", "hub"), "a").join(canon.toDF("b", "hub"), ["b", "hub"], "left_semi").join(hubs, "hub", "left_semi")
    shared = shared.groupBy("a", "b").agg(F.sort_array(F.collect_set("hub")).alias("shared"))
    return met.join(shared, ["a", "b"]).select("a", "b", "cosine", F.coalesce("meet", F.lit(False)).alias("overlap"), "shared")


def edge_inventory(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, without: str, most: int) -> DataFrame:
    """(src, src_title, rel, dst, dst_title, excerpt): at most ``most`` canonical edges between live nodes, not of the relation
    ``without``, the newest sources first; only their first chunks are read."""
    n = live(nodes)
    rows = edges.where("origin = 'canonical'").where(F.col("rel") != without).select("src", "rel", "dst")
    rows = rows.join(n.select(F.col("id").alias("src"), F.col("title").alias("src_title"), "created_on"), "src").join(n.select(F.col("id").alias("dst"), F.col("title").alias("dst_title")), "dst")
    top = rows.orderBy(F.desc_nulls_last("created_on"), "src", "rel", "dst").limit(most)
    first = chunks.where("chunk_index = 0").select(F.col("node_id").alias("src"), F.col("content").alias("excerpt"))
    held = first.join(F.broadcast(top.select("src").distinct()), "src", "left_semi")
    return top.join(held, "src", "left").select("src", "src_title", "rel", "dst", "dst_title", "excerpt")


def browse(nodes: DataFrame, text: str) -> DataFrame:
    """(id, type, title, tier): entities that match, exact title first, then prefix, alias, contained."""
    q = F.lit(" ".join(text.lower().split()))
    title, aliases = normalize_alias(F.col("title")), F.transform("aliases", normalize_alias)
    tier = F.when(title == q, 0).when(title.startswith(q), 1).when(F.exists(aliases, lambda a: a == q), 2).when(F.contains(title, q), 3).when(F.exists(aliases, lambda a: F.contains(a, q)), 4)
    return live(nodes).where(F.col("type").isin(ENTITY_TYPES)).select("id", "type", "title", tier.alias("tier")).where("tier is not null")


def degrees(links: DataFrame) -> DataFrame:
    return links.groupBy("id").agg(F.count("*").alias("degree"))


def first_by(df: DataFrame, keys: list[str], order: list, most: int = 1) -> DataFrame:
    """The first ``most`` rows of a key, in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
