"""Edit-aware token counts: a segment tree over each document's pre-tokens, kept in a table and updated where the text is edited.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum of its pre-tokens' counts. Leaves hold about
``leaf`` pre-tokens each with their characters and tokens; the tree above holds sums. A table keeps each text with its leaves; the sums above are added up
when a tree is taken out. An edit (start, end, replacement) re-encodes
from the last pre-token boundary that it cannot have moved (``CONTEXT`` characters before it) to the first old
boundary after it at which the new pre-tokens fall in step; leaves outside are kept with their counts, and only the sums above changed leaves are renewed.

Nulls and edges: a null text counts as empty; edits are clipped to the text and apply in order, each to the result of the one before; null replacements
are empty; no edits or null edits leave the counts; rows that repeat are all counted; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, slices

#: Characters before an edit that can look into it: a contraction's three and one of look-ahead.
CONTEXT = 4
CACHE_WORDS = 500_000
_OPEN: dict[str, "PreTokens"] = {}


class PreTokens(dict):
    """Token counts of pre-tokens, remembered by the worker; the table starts anew when it is full."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.find = regex.compile(public_tokenizers.PATTERN).finditer
        self.all = regex.compile(public_tokenizers.PATTERN).findall

    @classmethod
    def of(cls, path: str) -> "PreTokens":
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 100:
            self[word] = n
        return n


class SegmentTree:
    """Sums of (characters, tokens) over the leaves; levels[0] are the leaves."""

    def __init__(self, text: str, words: PreTokens, leaf: int = 32):
        self.text, self.words, self.leaf, self.encoded = text, words, leaf, 0
        self._build(self._leaves(words.all(text)))

    @classmethod
    def kept(cls, text: str, leaves: list[tuple[int, int]], words: PreTokens, leaf: int = 32) -> "SegmentTree":
        """The tree of a text whose leaves are known: nothing is encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.words, tree.leaf, tree.encoded = text, words, leaf, 0
        tree._build(list(leaves))
        return tree

    def _leaves(self, pre: list[str], size: int | None = None) -> list[tuple[int, int]]:
        self.encoded += len(pre)
        at = range(0, len(pre), size or self.leaf)
        return [(sum(map(len, part)), sum(map(self.words.__getitem__, part))) for part in (pre[i : i + (size or self.leaf)] for i in at)]

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.levels = [leaves or [(0, 0)]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([(low[i][0] + (low[i + 1][0] if i + 1 < len(low) else 0), low[i][1] + (low[i + 1][1] if i + 1 < len(low) else 0)) for i in range(0, len(low), 2)])

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf that holds a character, the leaf's first character), going down the tree."""
        node, first = 0, 0
        for level in range(len(self.levels) - 2, -1, -1):
            node *= 2
            low = self.levels[level]
            if node + 1 < len(low) and char >= first + low[node][0]:
                first += low[node][0]
                node += 1
        return node, first

    def edit(self, start: int, end: int, new: str) -> None:
        size = len(self.text)
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        text = self.text[:start] + new + self.text[end:]
        low, first = self._leaf_at(max(0, start - CONTEXT))
        if low and first > start - CONTEXT:  # the leaf's own start may move
            low -= 1
            first -= self.levels[0][low][0]
        high, after = self._leaf_at(end) if end < size else (len(self.levels[0]) - 1, size - self.levels[0][-1][0])
        # the next old boundary after the edit, where it lies now; it moves on with the pre-tokens that are found
        leaves, until = self.levels[0], high + 1
        stop, pre = after + leaves[high][0] + len(text) - size, []
        for m in self.words.find(text, first):
            while until < len(leaves) and stop < m.start():
                stop += leaves[until][0]
                until += 1
            if until < len(leaves) and stop == m.start():
                break
            pre.append(m.group())
        else:
            until = len(leaves)
        self.text, old = text, until - low
        if old <= len(pre) <= 2 * self.leaf * old:  # the same number of leaves can hold them: only their ancestors' sums change
            cuts = [len(pre) * i // old for i in range(old + 1)]
            self._renew(low, [self._leaves(pre[a:b], b - a)[0] for a, b in zip(cuts, cuts[1:])])
        else:
            self._build(leaves[:low] + self._leaves(pre) + leaves[until:])

    def _renew(self, low: int, made: list[tuple[int, int]]) -> None:
        self.levels[0][low : low + len(made)] = made
        a, b = low, low + len(made) - 1
        for below, level in zip(self.levels, self.levels[1:]):
            a, b = a // 2, b // 2
            for i in range(a, b + 1):
                level[i] = tuple(map(sum, zip(*below[2 * i : 2 * i + 2], strict=True)))


_LEAVES = "array<struct<chars:int,tokens:int>>"


def _leaves_out(trees: list[SegmentTree]) -> pa.Array:
    kind = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
    return pa.array([[{"chars": c, "tokens": t} for c, t in tree.levels[0]] for tree in trees], kind)


def _built(path: str, leaf: int):
    def run(batches):
        words = PreTokens.of(path)
        for whole in batches:
            for b in slices(whole, "text"):
                trees = [SegmentTree(t or "", words, leaf) for t in b.column("text").to_pylist()]
                made = [pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.encoded for t in trees], pa.int64()), _leaves_out(trees)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *made], ["doc_id", "text", "tokens", "pre_tokens", "leaves"])

    return run


def _updated(path: str, leaf: int, keep: bool):
    def run(batches):
        words = PreTokens.of(path)
        for whole in batches:
            for b in slices(whole, "text"):
                trees = []
                for text, leaves, edits in zip(*(b.column(c).to_pylist() for c in ("text", "leaves", "edits")), strict=True):
                    tree = SegmentTree.kept(text or "", [(x["chars"], x["tokens"]) for x in leaves], words, leaf)
                    for e in edits or []:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    trees.append(tree)
                numbers = [pa.array(x, pa.int64()) for x in ([t.tokens for t in trees], [t.encoded for t in trees], [len(t.text) for t in trees])]
                out = {"doc_id": b.column("doc_id"), "tokens_before": b.column("tokens"), "tokens_after": numbers[0], "pre_tokens": b.column("pre_tokens"), "re_encoded": numbers[1], "chars_after": numbers[2]}
                if keep:
                    out |= {"text": pa.array([t.text for t in trees], pa.string()), "leaves": _leaves_out(trees)}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def build_trees(docs: DataFrame, tokenizer: str | None = None, leaf: int = 32) -> DataFrame:
    """doc_id, text, tokens, pre_tokens, leaves: the trees of ``docs``, written to the shared folder."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(given.mapInArrow(_built(tokenizer or byte_bpe(), leaf), f"doc_id long, text string, tokens long, pre_tokens long, leaves {_LEAVES}"), "zstd")


def update_trees(trees: DataFrame, tokenizer: str | None = None, leaf: int = 32, keep: bool = False) -> DataFrame:
    """Counts before and after the edits of ``trees`` with a column edits (array of start, end, text), and how many pre-tokens were encoded again.

    With ``keep``, also the new text and leaves: the next state of the table.
    """
    given = trees.withColumn("edits", F.col("edits").cast("array<struct<start:long,end:long,text:string>>"))
    schema = "doc_id long, tokens_before long, tokens_after long, pre_tokens long, re_encoded long, chars_after long" + f", text string, leaves {_LEAVES}" * keep
    return given.mapInArrow(_updated(tokenizer or byte_bpe(), leaf, keep), schema)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the edits of a table ``edits(doc_id, seq, start, end, text)``, in order of seq, for every row of that doc_id; a document's edits are gathered, so they must be few."""
    e = edits.groupBy(F.col("doc_id").cast("long").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))).alias("_e"))
    one = F.transform("_e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    return trees.join(e, F.col("doc_id") == F.col("_of"), "left").withColumn("edits", one).drop("_of", "_e")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents, each with two edits of its kept tree: its first line break goes, and a mark enters in the middle of a word half way."""
    trees = build_trees(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce("text", F.lit(""))
    half, line = F.floor(F.length(text) / 2), F.instr(text, F.lit("\n"))
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(t).alias("text"))
    edits = F.array(edit(half, half, "'s <edit> 42"), edit(F.greatest(line - 1, F.lit(0)), line, ""))
    return update_trees(trees.withColumn("edits", F.when(F.col("text").isNotNull(), edits)))
