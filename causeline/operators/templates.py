"""Template mining and grouping (M1-M7, M10-M14, R9), and the strategy registries.

Mining takes rows with ``lid`` and ``words`` and returns (lid, tid) with templates (tid, tpl, cnt). Order matters to SHISO, so its exact
mode is one ordered task; ``by_length`` runs the lengths side by side, which is sound because templates merge only at
equal length, but the trees differ, so that results may.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import WILDCARD, matches_template, ngrams
from .ids import dense_ids


# --- word distances ---


def edit_distance(a: list[str], b: list[str], wildcard: str = WILDCARD) -> int:
    """Levenshtein distance over words; the wildcard fits any word."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        cost = np.array([0 if x == y or wildcard in (x, y) else 1 for y in b], int)
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + cost)
        # insertions chain along the row
        new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        row = new
    return int(row[-1])


def char_vector(word: str) -> np.ndarray:
    """Unit histogram over A-Z, a-z, digits, others."""
    v = np.zeros(54)
    for c in word:
        if "A" <= c <= "Z":
            v[ord(c) - 65] += 1
        elif "a" <= c <= "z":
            v[ord(c) - 71] += 1
        elif c.isdigit():
            v[52] += 1
        else:
            v[53] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


class WordVectors(dict):
    def __missing__(self, word: str) -> np.ndarray:
        self[word] = v = char_vector(word)
        return v


def seq_ratio(a: list[str], b: list[str], vectors: WordVectors, wildcard: str = WILDCARD) -> float:
    """Likeness of two word lists of one length by their words' letters."""
    if len(a) != len(b):
        return 0.0
    if not a:
        return 1.0
    total = 0.0
    for x, y in zip(a, b):
        if x != y and wildcard not in (x, y):
            d = vectors[x] - vectors[y]
            total += float(d @ d)
    return 1.0 - total / (2.0 * len(a))


# --- SHISO ---


class _Node:
    __slots__ = ("tid", "children")

    def __init__(self, tid: int | None = None):
        self.tid, self.children = tid, []


class Shiso:
    """Incremental tree of templates (M4). compat: go down to the least similar child, as first published code does."""

    def __init__(self, threshold: float = 0.9, max_child: int = 4, wildcard: str = WILDCARD, compat: bool = False):
        self.threshold, self.max_child, self.wildcard, self.compat = threshold, max_child, wildcard, compat
        self.root, self.templates, self.vectors = _Node(), [], WordVectors()

    def add(self, words: list[str]) -> int:
        node = self.root
        while True:
            for child in node.children:
                own = self.templates[child.tid]
                if seq_ratio(own, words, self.vectors, self.wildcard) >= self.threshold:
                    self.templates[child.tid] = [x if x == y else self.wildcard for x, y in zip(own, words)]
                    return child.tid
            if len(node.children) < self.max_child:
                self.templates.append(list(words))
                node.children.append(_Node(len(self.templates) - 1))
                return len(self.templates) - 1
            far = [edit_distance(self.templates[c.tid], words, self.wildcard) for c in node.children]
            node = node.children[int(np.argmax(far) if self.compat else np.argmin(far))]


def shiso(log: DataFrame, threshold: float = 0.9, max_child: int = 4, mode: str = "sharded", compat: bool = False, shards: int = 64) -> DataFrame:
    """(lid, n, local, tpl): each line's template, numbered within its length.

    ``sharded`` mines ``shards`` parts of each length side by side and then mines the parts' templates, so that no task holds a length's lines; trees
    see lines in another order there. ``by_length`` keeps one tree for each length in one ordered task each, ``exact`` one for all lengths.
    """
    if mode not in ("by_length", "exact", "sharded"):
        raise ValueError(f"unknown mode {mode!r}")

    def grow(group: pd.DataFrame, words: str, order: list[str]) -> tuple[pd.DataFrame, list[int], list[list[str]]]:
        group = group.sort_values(order)
        tree = Shiso(threshold, max_child, compat=compat)
        tids = [tree.add(list(w)) for w in group[words]]
        return group, tids, tree.templates

    def lines(group: pd.DataFrame) -> pd.DataFrame:
        group, tids, tpl = grow(group, "words", ["lid"])
        return pd.DataFrame({"lid": group["lid"], "n": group["n"], "k": group["k"], "local": tids, "tpl": [tpl[t] for t in tids]})

    rows = log.select("lid", "words", F.size("words").alias("n"))
    key = {"exact": F.lit(0), "by_length": F.lit(0), "sharded": F.pmod(F.xxhash64("lid"), F.lit(shards)).cast("int")}[mode]
    by = ["k"] if mode == "exact" else ["n", "k"]
    mined = rows.withColumn("k", key).groupBy(*by).applyInPandas(lines, "lid long, n int, k int, local int, tpl array<string>")
    if mode != "sharded":
        return mined.select("lid", "n", "local", "tpl")

    def parts(group: pd.DataFrame) -> pd.DataFrame:
        group, tids, tpl = grow(group, "tpl", ["k", "local"])
        return pd.DataFrame({"n": group["n"], "k": group["k"], "local": group["local"], "whole": tids, "tpl": [tpl[t] for t in tids]})

    from ..plans.checkpoint import cut

    mined = cut(mined)
    some = mined.select("n", "k", "local", "tpl").distinct()
    whole = some.groupBy("n").applyInPandas(parts, "n int, k int, local int, whole int, tpl array<string>")
    return mined.drop("tpl").join(whole, ["n", "k", "local"]).select("lid", "n", F.col("whole").alias("local"), "tpl")


def numbered(mined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lid, tid) and (tid, tpl, cnt); tid in order of first lines."""
    tpl = mined.groupBy("tpl").agg(F.min("lid").alias("first_lid"), F.count(F.lit(1)).alias("cnt"))
    tpl = dense_ids(tpl, ["first_lid"], "tid")
    lines = mined.join(tpl.select("tpl", "tid"), "tpl").select("lid", "tid")
    return lines, tpl.select("tid", "tpl", "cnt")


# --- word frequency ---


def frequent_words(log: DataFrame, share: float = 0.6) -> DataFrame:
    """(lid, tpl): words at least as frequent as the line's ceil(share * n)-th most frequent stay."""
    each = log.select("lid", F.posexplode("words").alias("pos", "word"))
    freq = each.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    rows = each.join(freq, "word").groupBy("lid").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "freq"))).alias("ws"))
    ordered = F.sort_array(F.transform("ws", lambda x: x["freq"]), asc=False)
    bound = F.element_at(ordered, F.ceil(F.size("ws") * share).cast("int"))
    return rows.withColumn("bound", bound).select("lid", F.transform("ws", lambda x: F.when(x["freq"] >= F.col("bound"), x["word"]).otherwise(WILDCARD)).alias("tpl"))


# --- given templates ---


#: Templates of at most so many characters in all are broadcast; more are joined by shuffles, whose hot words are left to adaptive skew splitting.
MOST_CHARS = 2_000_000

#: So many places of first literals, the commonest, get an anti-join of their own; the templates of all others are met by length.
MOST_PLACES = 8


def _keyed(templates: DataFrame) -> DataFrame:
    """(tid, tpl, n, at, lit): templates with their length and their first literal with its place from 1; 0 and no text if there is none."""
    t = templates.select("tid", "tpl", F.size("tpl").alias("n"), F.expr(f"array_position(transform(tpl, x -> x <> '{WILDCARD}'), true)").cast("int").alias("at"))
    return t.filter("at is not null").withColumn("lit", F.when(F.col("at") > 0, F.get("tpl", F.col("at") - 1)).otherwise(""))


def _places(t: DataFrame) -> tuple[list[int], Callable[[DataFrame], DataFrame]]:
    """The commonest places of first literals, and how templates are handed to a join."""
    rows = t.groupBy("at").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length(F.array_join("tpl", " ", ""))).alias("chars")).collect()
    common = sorted((r for r in rows if r["at"]), key=lambda r: (-r["k"], r["at"]))[:MOST_PLACES]
    return [r["at"] for r in common], F.broadcast if sum(r["chars"] for r in rows) <= MOST_CHARS else lambda df: df


def match_templates(log: DataFrame, templates: DataFrame) -> DataFrame:
    """(lid, tid) by the given (tid, tpl); of several, the one that is literal at the earliest place where they differ (M5, M6).

    Lines join templates on length and on the template's first literal with its place, so that a line meets only templates that share a word
    with it; templates of wildcards alone join on length. A line comes once for each place that its length's templates have. Up to
    ``MOST_CHARS`` of templates it is matched where it was read, and only numbers are shuffled.
    """
    t = _keyed(templates)
    _, handed = _places(t)
    rank = F.transform("tpl", lambda x: F.when(x == WILDCARD, 1).otherwise(0))
    t = t.withColumn("order", F.shiftleft(F.col("n").cast("long"), 32) + F.row_number().over(Window.partitionBy("n").orderBy(rank, "tid")))
    rows = log.select("lid", "words", F.size("words").alias("n")).join(handed(t.select("n", "at").distinct()), "n")
    rows = rows.withColumn("lit", F.when(F.col("at") > 0, F.get("words", F.col("at") - 1)).otherwise(""))
    found = rows.join(handed(t), ["n", "at", "lit"]).filter(matches_template(F.col("words"), F.col("tpl")))
    return found.groupBy("lid").agg(F.min_by("tid", "order").alias("tid"))


def unmatched(log: DataFrame, templates: DataFrame) -> DataFrame:
    """Lines that match no template (M7, K8), each looked at by itself, whatever its ``lid``."""
    t = _keyed(templates).select("at", F.col("n").alias("__n"), F.col("lit").alias("__lit"), F.col("tpl").alias("__tpl"))
    places, handed = _places(_keyed(templates))
    fits = (F.size("words") == F.col("__n")) & matches_template(F.col("words"), F.col("__tpl"))
    out = log
    for p in places:
        out = out.join(handed(t.filter(F.col("at") == p).drop("at")), (F.get("words", F.lit(p - 1)) == F.col("__lit")) & fits, "left_anti")
    return out.join(handed(t.filter(~F.col("at").isin(places)).drop("at", "__lit")), fits, "left_anti")


class TemplateTrie:
    """Word trie with wildcard branches; literal first, then back to the latest wildcard passed."""

    def __init__(self, wildcard: str = WILDCARD):
        self.wildcard, self.root = wildcard, {}

    def add(self, template: list[str], tid: int) -> None:
        node = self.root
        for w in template:
            node = node.setdefault(w, {})
        node[None] = tid

    def search(self, words: list[str]) -> int | None:
        stack = [(self.root, 0)]
        while stack:
            node, k = stack.pop()
            if k == len(words):
                if None in node:
                    return node[None]
                continue
            if self.wildcard in node:
                stack.append((node[self.wildcard], k + 1))
            if words[k] != self.wildcard and words[k] in node:
                stack.append((node[words[k]], k + 1))
        return None

    def remove(self, template: list[str]) -> int | None:
        path, node = [], self.root
        for w in template:
            if w not in node:
                return None
            path.append((node, w))
            node = node[w]
        tid = node.pop(None, None)
        for parent, w in reversed(path):
            if parent[w]:
                break
            del parent[w]
        return tid


# --- groups ---


def group_none(lt: DataFrame) -> DataFrame:
    """Each template is its own group."""
    return lt.select("ltid", F.col("ltid").alias("ltgid"))


def shared_ngrams(lt: DataFrame, n: int = 3, compat: bool = False) -> DataFrame:
    """(ltid, older, shared): n-grams that a template has in common with each older one, by a join on n-grams."""
    grams = lt.select("ltid", F.explode(ngrams(F.col("ltw"), n, compat)).alias("gram"))
    a, b = grams, grams.select(F.col("ltid").alias("older"), F.col("gram")).distinct()
    return a.join(b, "gram").filter("older < ltid").groupBy("ltid", "older").agg(F.count(F.lit(1)).alias("shared"))


def group_shiso(lt: DataFrame, n: int = 3, ratio: float = 0.3, distance: float = 0.85, compat: bool = False) -> DataFrame:
    """(ltid, ltgid): a template joins the group of the older one that shares most n-grams, if near enough.

    Templates come one after the other; only those that share n-grams are looked at. There are as many rows as templates.
    """
    pairs = shared_ngrams(lt, n, compat).groupBy("ltid").agg(F.collect_list(F.struct("older", "shared")).alias("near"))
    rows = lt.select("ltid", "ltw").join(pairs, "ltid", "left")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ltid")
        words, own, new = {}, {}, 0
        for ltid, ltw, near in zip(group["ltid"], group["ltw"], group["near"]):
            ltw = list(ltw)
            mine = max(len(ltw) - n + (0 if compat else 1), 0)
            best, at = 0.0, None
            for o, s in sorted((x["older"], x["shared"]) for x in (near if near is not None else [])):
                theirs = n if compat else max(len(words[o]) - n + 1, 0)
                r = 2.0 * s / (mine + theirs)
                if r > best:
                    best, at = r, o
            close = at is not None and best > ratio and 2.0 * edit_distance(ltw, words[at]) / (len(ltw) + len(words[at])) < distance
            own[ltid] = own[at] if close else new
            new += not close
            words[ltid] = ltw
        return pd.DataFrame({"ltid": list(own), "ltgid": list(own.values())})

    return rows.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(lambda g: run(g.drop(columns="k")), "ltid int, ltgid int")


def group_jaccard(lt: DataFrame, least: float = 0.5) -> DataFrame:
    """(ltid, ltgid) by word overlap: stands in for fuzzy hashes, whose library isn't public here."""
    from .graph import connected

    w = lt.select("ltid", F.array_distinct("ltw").alias("s"))
    each = w.select("ltid", F.size("s").alias("n"), F.explode("s").alias("w"))
    other = each.select(F.col("ltid").alias("b"), F.col("n").alias("nb"), "w")
    pairs = each.join(other, "w").filter("ltid < b").groupBy("ltid", "b").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("nb").alias("nb"))
    links = pairs.filter(F.col("k") / (F.col("n") + F.col("nb") - F.col("k")) >= least).select(F.col("ltid").alias("src"), F.col("b").alias("dst"))
    return connected(lt.select(F.col("ltid").alias("node")), links).select(F.col("node").alias("ltid"), F.col("component").cast("int").alias("ltgid"))


def vary(lines: DataFrame, templates: DataFrame, log: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Log templates: one for each template with its variables' labels put in (M1, M2, R9). ``groups(word, grp)``.

    Returns (lid, ltid) and (ltid, tid, ltw, cnt), numbered by first lines.
    """
    rows = lines.join(templates.select("tid", "tpl"), "tid").join(log.select("lid", "words"), "lid")
    if groups is None:
        rows = rows.withColumn("ltw", F.col("tpl"))
    else:
        each = rows.select("lid", "tid", "tpl", F.posexplode(F.arrays_zip("words", "tpl")).alias("pos", "x"))
        each = each.join(groups.select(F.col("word").alias("__w"), "grp"), F.col("x.words") == F.col("__w"), "left")
        word = F.when(F.col("x.tpl") != WILDCARD, F.col("x.tpl")).otherwise(F.coalesce(F.concat(F.lit("*"), F.col("grp"), F.lit("*")), F.lit(WILDCARD)))
        each = each.groupBy("lid", "tid").agg(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))).alias("ws"))
        rows = each.select("lid", "tid", F.transform("ws", lambda x: x["w"]).alias("ltw"))
    lt = rows.groupBy("tid", "ltw").agg(F.min("lid").alias("first_lid"), F.count(F.lit(1)).alias("cnt"))
    lt = dense_ids(lt, ["first_lid"], "ltid")
    return rows.join(lt.select("tid", "ltw", "ltid"), ["tid", "ltw"]).select("lid", "ltid"), lt.select("ltid", "tid", "ltw", "cnt")


def fold_templates(rows: DataFrame, *by: str) -> DataFrame:
    """The template of all ``words`` of a group: places where all agree, and the wildcard elsewhere (F16 folded).

    A place agrees if its least and greatest words are equal, so that groups are pre-aggregated, never gathered.
    """
    each = rows.select(*by, F.size("words").alias("n"), F.posexplode("words").alias("pos", "w"))
    spot = each.groupBy(*by, "pos").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    shortest = rows.groupBy(*by).agg(F.min(F.size("words")).alias("n"))
    spot = spot.join(shortest, list(by)).filter("pos < n")
    word = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(WILDCARD)
    return spot.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))).alias("ws")).select(*by, F.transform("ws", lambda x: x["w"]).alias("ltw"))


#: Strategies by name. ``crf`` is a place for a tagger that labels words D or V: register a function (log) -> (lid, tpl).
MINERS: dict[str, Callable] = {"shiso": shiso, "va": frequent_words, "import": match_templates}
GROUPERS: dict[str, Callable] = {"shiso": group_shiso, "none": group_none, "jaccard": group_jaccard}


def tagged(log: DataFrame, tag: Callable[[list[list[str]]], list[list[str]]]) -> DataFrame:
    """(lid, tpl) from a tagger of word lists: words labelled V become wildcards (M8, M9)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [list(w) for w in b["words"]]
            labels = tag(words)
            yield pd.DataFrame({"lid": b["lid"], "tpl": [[WILDCARD if k == "V" else w for w, k in zip(ws, ks)] for ws, ks in zip(words, labels)]})

    return log.select("lid", "words").mapInPandas(run, "lid long, tpl array<string>")


def training_lines(log: DataFrame, lt: DataFrame) -> DataFrame:
    """(ltid, pos, line): ``word label label`` of one line of each template, D for literals, V for variables."""
    first = log.groupBy("ltid").agg(F.min_by("words", "lid").alias("words"))
    each = first.join(lt.select("ltid", "ltw"), "ltid").select("ltid", F.posexplode(F.arrays_zip("words", "ltw")).alias("pos", "x"))
    label = F.when(F.col("x.ltw") == WILDCARD, "V").otherwise("D")
    return each.select("ltid", "pos", F.concat_ws(" ", "x.words", label, label).alias("line"))


def distinct_templates(*parts: DataFrame) -> DataFrame:
    """(tpl, cnt): templates of several sources as one set."""
    whole = parts[0].select("tpl", "cnt")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("tpl", "cnt"))
    return whole.groupBy("tpl").agg(F.sum("cnt").alias("cnt"))
