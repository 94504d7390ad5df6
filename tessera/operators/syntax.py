"""Shapes of SQL statements: a tree for each query, and the hashes of all its subtrees.

Two statements that differ in literals, aliases or the order of conditions have
the same hashes.  The parser knows the grammar of queries only as far as shapes
need it: clauses, lists, operators, calls, subqueries and set operations.  What
it does not know stays a flat list of words, so every text has some tree.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.sets import jaccard
from tessera.functions.text import sql_blocks
from tessera.storage import materialize

TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?P<lit>'(?:''|[^'])*'|\b\d+(?:\.\d+)?\b)|(?P<name>[A-Za-z_#$][\w#$]*|\"[^\"]*\"|\[[^\]]*\]|`[^`]*`)|(?P<sign><=|>=|<>|!=|\|\||.)", re.DOTALL)
# Words that begin a clause, in the order that a query has them; words of joins; operators by how loosely they bind.
CLAUSES = ["with", "select", "from", "where", "group", "having", "qualify", "window", "order", "limit", "offset"]
SET_WORDS = {"union", "intersect", "except", "minus"}
JOIN_WORDS = {"join", "inner", "left", "right", "full", "cross", "outer", "natural"}
LEVELS = [["or"], ["and"], ["not"], ["=", "<>", "!=", "<", ">", "<=", ">=", "like", "ilike", "in", "is", "between"], ["+", "-", "||"], ["*", "/", "%"]]
#: Open subqueries and calls that are parsed as trees; deeper text stays flat.
DEEPEST = 40
#: Sets of a component whose pairs are joined, at most; sets of one block of a larger one, about.
PAIRED, BLOCK_SETS = 64, 10000
#: Rows of a product of blocks, and elements, that are held at once.
TILE, COLUMNS = 256, 1024


def tokens(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group().lower()) for m in TOKEN.finditer(sql) if m.lastgroup]


def bare(name: str) -> str:
    return name.strip('"[]`')


class Parser:
    """Nodes are (kind, children) tuples, or texts for leaves."""

    def __init__(self, sql: str):
        self.all, self.at, self.depth = tokens(sql), 0, 0

    def word(self, ahead: int = 0) -> str:
        return self.all[self.at + ahead][1] if self.at + ahead < len(self.all) else ""

    def take(self, *words: str) -> bool:
        if self.word() in words and self.at < len(self.all):
            self.at += 1
            return True
        return False

    def flat(self) -> str:
        """One token of a text too deep for trees, so that what differs there has another shape."""
        if self.at >= len(self.all):
            return "none"
        kind, text = self.all[self.at]
        self.at += 1
        return "deep lit" if kind == "lit" else f"deep {text}"

    def query(self):
        if self.depth >= DEEPEST:
            return self.flat()
        self.depth += 1
        try:
            return self.whole_query()
        finally:
            self.depth -= 1

    def whole_query(self):
        parts = [self.simple()]
        while self.word() in SET_WORDS:
            kind = self.word()
            self.at += 1
            kind += " all" if self.take("all") else ""
            self.take("distinct")
            parts = [(kind, [*parts, self.simple()])]
        return parts[0]

    def simple(self):
        found = []
        if self.take("insert"):
            self.take("into")
            found.append(("insert", [self.table()]))
        while self.at < len(self.all) and self.word() not in SET_WORDS and self.word() not in (")", ";"):
            clause = self.word()
            start = self.at
            if clause == "(":
                self.at += 1
                found.append(self.query())
                self.take(")")
            elif clause in CLAUSES:
                self.at += 1
                self.take("by")
                if clause == "select":
                    clause += " distinct" if self.take("distinct") else ""
                found.append((clause, self.tables() if clause == "from" else self.named_queries() if clause == "with" else self.items()))
            else:
                found.append(self.leaf())
            if self.at == start:
                self.at += 1
        return ("query", found)

    def named_queries(self):
        out = []
        while True:
            self.take("recursive")
            name = bare(self.word())
            self.at += 1
            if self.word() == "(":
                self.items_inside()
            self.take("as")
            if self.take("("):
                out.append(("cte", [f"tbl:{name}", self.query()]))
                self.take(")")
            if not self.take(","):
                return out

    def ends(self) -> bool:
        return self.at >= len(self.all) or self.word() in (")", ",", ";") or self.word() in CLAUSES or self.word() in SET_WORDS

    def items(self):
        out = []
        while True:
            out.append(self.expression(0))
            self.alias()
            self.take("asc")
            if self.take("desc"):
                out[-1] = ("desc", [out[-1]])
            if not self.take(","):
                return out

    def alias(self):
        if self.take("as") or (not self.ends() and self.all[self.at][0] == "name" and self.word() not in JOIN_WORDS and self.word() not in ("on", "using", "asc", "desc", "end", "when", "then", "else", "and", "or")):
            self.at += 1

    def tables(self):
        out = []
        while not (self.at >= len(self.all) or self.word() in (")", ";") or self.word() in CLAUSES or self.word() in SET_WORDS):
            kind = []
            while self.word() in JOIN_WORDS:
                kind.append(self.word())
                self.at += 1
            start, node = self.at, self.table()
            self.alias()
            if self.take("on"):
                node = ("on", [node, self.expression(0)])
            elif self.take("using"):
                node = ("using", [node, *self.items_inside()])
            out.append((" ".join(kind), [node]) if kind else node)
            self.take(",")
            if self.at == start:
                self.at += 1
        return out

    def table(self):
        if self.take("("):
            node = self.query() if self.depth >= DEEPEST or self.word() in ("select", "with", "(") else ("tables", self.tables())
            self.take(")")
            return node
        name = bare(self.word())
        self.at += 1
        while self.word() == "." and self.at + 1 < len(self.all):
            name = bare(self.word(1))
            self.at += 2
        return f"tbl:{name}"

    def items_inside(self):
        if not self.take("("):
            return []
        out = [] if self.word() == ")" else self.items()
        self.take(")")
        return out

    def expression(self, level: int):
        if level == len(LEVELS):
            return self.leaf()
        if LEVELS[level] == ["not"]:
            times = 0
            while self.take("not"):
                times += 1
            inside = self.expression(level + 1)
            return ("not" if times == 1 else f"not {times}", [inside]) if times else inside
        left = self.expression(level + 1)
        while not self.ends():
            negative = self.word() == "not" and self.word(1) in LEVELS[level]
            operator = self.word(1) if negative else self.word()
            if operator not in LEVELS[level] or self.all[self.at][0] == "lit":
                break
            self.at += 1 + negative
            if operator == "is":
                negative = self.take("not")
                right = [self.expression(level + 1)]
            elif operator == "between":
                right = [self.expression(level + 1)]
                if self.take("and"):
                    right.append(self.expression(level + 1))
            else:
                right = [self.expression(level + 1)]
            if operator in ("and", "or"):
                parts = [x for side in (left, *right) for x in (side[1] if isinstance(side, tuple) and side[0] == operator else [side])]
                left = (operator, parts)
            else:
                left = (operator, [left, *right])
            if negative:
                left = ("not", [left])
        return left

    def leaf(self):
        if self.at >= len(self.all):
            return "none"
        kind, text = self.all[self.at]
        if self.depth >= DEEPEST:
            return self.flat()
        self.depth += 1
        try:
            return self.leaf_of(kind, text)
        finally:
            self.depth -= 1

    def leaf_of(self, kind: str, text: str):
        self.at += 1
        if kind == "lit":
            return "lit"
        if text == "(":
            node = self.query() if self.word() in ("select", "with") else ("list", [] if self.word() == ")" else self.items())
            self.take(")")
            return node[1][0] if node[0] == "list" and len(node[1]) == 1 else node
        if text in ("-", "+") and not self.ends():
            return ("sign" + text, [self.leaf()])
        if text == "case":
            out = []
            if self.word() != "when":
                out.append(self.expression(0))
            while self.at < len(self.all) and self.word() not in ("end", ")", ";"):
                start = self.at
                if self.word() in ("when", "then", "else"):
                    self.at += 1
                out.append(self.expression(0))
                if self.at == start:
                    self.at += 1
            self.take("end")
            return ("case", out)
        if kind != "name":
            return f"sign:{text}"
        name = bare(text)
        while self.word() == "." and self.at + 1 < len(self.all):
            name = bare(self.word(1))
            self.at += 2
        if self.word() == "(":
            self.at += 1
            distinct = self.take("distinct")
            inner = [self.query()] if self.word() in ("select", "with") else [] if self.word() == ")" else self.items()
            self.take(")")
            node = (f"call:{name}", [("distinct", inner)] if distinct else inner)
            if self.word() == "over" and self.word(1) == "(":
                self.at += 2
                node = ("over", [node, *self.window()])
                self.take(")")
            return node
        return f"col:{name}"

    def window(self):
        out = []
        while self.at < len(self.all) and self.word() != ")":
            start = self.at
            if self.word() in ("partition", "order"):
                kind = self.word()
                self.at += 1
                self.take("by")
                out.append((kind, self.items()))
            else:
                self.at += 1
            if self.at == start:
                self.at += 1
        return out


def shape(node, seen: set[str]) -> str:
    """Canonical text of a tree; the text of every subtree goes to ``seen``."""
    if isinstance(node, str):
        out = node
    else:
        parts = [shape(x, seen) for x in node[1]]
        out = f"({' '.join([node[0], *(sorted(parts) if node[0] in ('and', 'or') else parts)])})"
        if len(out) > 400:  # long texts stand for themselves by their hash
            out = f"({node[0]} {hashlib.sha256(out.encode()).hexdigest()})"
    seen.add(out)
    return out


def subtree_hashes(blocks: list[str]) -> list[str]:
    """Sorted hashes of all subtrees of some queries."""
    seen: set[str] = set()
    for sql in blocks:
        parser = Parser(sql)
        while parser.at < len(parser.all):
            start = parser.at
            shape(parser.query(), seen)
            parser.take(";", ")")
            if parser.at == start:
                parser.at += 1
    return sorted(hashlib.sha256(x.encode()).hexdigest()[:16] for x in seen)


def hash_statements(statements: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``report_id``, ``hashes`` for statements (report_id, sql) of reports that are not in ``known`` yet, which is kept.

    Null and empty statements have no hash.
    """
    rows = statements.where(F.coalesce("sql", F.lit("")) != "")
    if known is not None:
        rows = rows.join(known.select("report_id"), "report_id", "left_anti")
    blocks = sql_blocks(F.col("sql"), 0)
    rows = rows.select("report_id", F.when(F.size(blocks) > 0, blocks).otherwise(F.array("sql")).alias("blocks"))

    def run(batches):
        for b in batches:
            found = [subtree_hashes([x for x in y if x]) for y in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["report_id", "hashes"])

    out = rows.mapInArrow(run, f"report_id {rows.schema['report_id'].dataType.simpleString()}, hashes array<string>")
    return out if known is None else known.select("report_id", "hashes").unionByName(out)


def pair_statistics(members: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``component``, ``size``, ``mean``, ``least``, ``all_exact`` over all pairs of a component's members (report_id, component, hashes).

    Members with one set are one set with a weight, so copies make no pairs.
    Pairs of a component of up to PAIRED sets are joined; those of a larger one
    are products of blocks of about BLOCK_SETS sets, so that a task holds two
    blocks and returns two numbers.  Time is quadratic in a component's sets.
    """
    hashed = F.array_sort(F.transform(F.array_distinct("hashes"), lambda e: F.xxhash64(e)))
    sets = materialize(members.groupBy("component", hashed.alias("s")).agg(F.count("*").alias("n")), "sets")
    per = materialize(sets.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("sets"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same")), "components")
    few = sets.join(per.where(F.col("sets").between(2, PAIRED)).select("component"), "component")
    a, b = few.alias("a"), few.alias("b")
    score = jaccard(F.col("a.s"), F.col("b.s"))
    pairs = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.s") < F.col("b.s"))).select(F.col("a.component").alias("component"), (F.col("a.n") * F.col("b.n") * score).alias("total"), score.alias("least"))

    blocks = F.ceil(F.col("sets") / BLOCK_SETS)
    many = sets.join(per.where(F.col("sets") > PAIRED).select("component", blocks.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("s"), "blocks"))
    met = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "s")
    schema = T.StructType([met.schema["component"], T.StructField("total", T.DoubleType()), T.StructField("least", T.DoubleType())])
    parts = pairs.unionByName(met.groupBy("component", "i", "j").applyInArrow(block_statistics, schema))

    other = parts.groupBy("component").agg(F.sum("total").alias("total"), F.min("least").alias("least"))
    out = per.where("size >= 2").join(other, "component", "left")
    mean = (F.coalesce("total", F.lit(0.0)) + F.col("same")) / (F.col("size") * (F.col("size") - 1) / 2)
    return out.select("component", "size", mean.alias("mean"), F.coalesce("least", F.lit(1.0)).alias("least"), (F.col("sets") == 1).alias("all_exact"))


def block_statistics(key: tuple, table: pa.Table) -> pa.Table:
    """Weighted sum and least of the similarities of the pairs of two blocks, or of one, each pair once."""
    i, j = (x.as_py() for x in key[1:])
    lists = table.column("s").combine_chunks()
    sizes, elements = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    block, weight = table.column("block").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    names, places, held = np.unique(elements, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    shared = held[places] > 1  # what one set alone has is in no pair
    names = np.unique(places[shared])
    rows, places = rows[shared], np.searchsorted(names, places[shared])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    total, least = 0.0, 1.0
    slices = []  # the sets as rows of 0 and 1, a bounded number of elements at a time
    for at in range(0, len(names), COLUMNS):
        inside = (places >= at) & (places < at + COLUMNS)
        slices.append((rows[inside], places[inside] - at, min(COLUMNS, len(names) - at)))

    def ones(part, chosen):
        r, c, width = part
        local = np.full(len(sizes), -1)
        local[chosen] = np.arange(len(chosen))
        x = np.zeros((len(chosen), width), np.float32)
        known = local[r] >= 0
        x[local[r[known]], c[known]] = 1
        return x

    whole = [ones(part, right) for part in slices] if len(slices) == 1 else None
    for at in range(0, len(left), TILE):
        chosen = left[at : at + TILE]
        first = at if i == j else 0  # earlier ones have met these
        against = right[first:]
        both = np.zeros((len(chosen), len(against)), np.float32)
        for k, part in enumerate(slices):
            both += ones(part, chosen) @ (whole[k][first:] if whole else ones(part, against)).T
        union = sizes[chosen].astype(np.float32)[:, None] + sizes[against].astype(np.float32)[None, :]
        union -= both
        score = both.astype(np.float64)
        with np.errstate(invalid="ignore"):
            score /= union
        score[union == 0] = 1.0  # two empty sets are alike
        if i == j:
            square = score[:, : len(chosen)]
            lower = np.tril_indices(len(chosen))
            square[lower] = 1.0
            least = min(least, float(score.min()))
            square[lower] = 0.0
        else:
            least = min(least, float(score.min(initial=1.0)))
        total += float(weight[chosen] @ score @ weight[against])
    return pa.table({"component": pa.array([key[0].as_py()], key[0].type), "total": [total], "least": [least]})


def exact_groups(hashes: DataFrame) -> DataFrame:
    """Statements parsed, groups of equal sets, their members and how many of these are removable."""
    per = hashes.where(F.size("hashes") > 0).groupBy(F.array_sort(F.array_distinct("hashes")).alias("s")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("parsed"), F.count_if(F.col("n") >= 2).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("in_groups"), F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n") - 1)), F.lit(0)).alias("removable"))
