"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for word starts and one for continuations. Each
node knows where to go on when no child fits (its failure link) and how many pieces are popped
on the way, so the greedy longest-match length of a word is one pass over its characters, and
no piece is ever built. A word that cannot be spelled counts as one unknown piece.

A word that no starting piece fits begins with the bare blank piece and goes on with
continuations, and a character without any piece is spelled by byte pieces, so only what the file
cannot spell is unknown. Both are left out unless asked for (`spell`), as op6 does.

Words are runs of word characters; every other character that is not white space is a word.
Null texts are empty and count 0. Texts and words may be of any length. An empty table gives an
empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, table, whole
from .vocab import Memo, kept, public

WORDS = re.compile(r"\w+|[^\w\s]")
_DEAD = -1


class Automaton:
    """starts, inner: the pieces that can begin a word and those that can continue one.

    blank: pieces of the bare blank, with which any word can begin; 0 if there are none.
    spelled: pieces of a character where no other piece fits; 0 if it has none.
    """

    def __init__(self, starts, inner, blank: int = 0, spelled=lambda c: 0):
        self.child: dict[tuple[int, str], int] = {}
        self.link, self.pops = [1 if blank else _DEAD, _DEAD], [blank, 0]  # of the roots: 0 for starts, 1 for continuations
        self.spelled = spelled
        self.counts = Memo(self._count)
        ends, order, parent = set(), [], []
        for root, pieces in ((0, starts), (1, inner)):
            for piece in pieces:
                v = root
                for c in piece:
                    if (v, c) not in self.child:
                        self.child[v, c] = len(self.link)
                        order.append((len(self.link), v, c))
                        self.link.append(_DEAD)
                        self.pops.append(0)
                    v = self.child[v, c]
                if v > 1:
                    ends.add(v)
        depth = [0, 0]
        for _, v, _c in order:
            depth.append(depth[v] + 1)
        for v, u, c in sorted(order, key=lambda x: depth[x[0]]):
            if v in ends:
                self.link[v], self.pops[v] = 1, 1
                continue
            z, n = u, 0
            while z not in (_DEAD, 1) and (z == u or (z, c) not in self.child):
                n += self.pops[z]
                z = self.link[z]
            if z == 1 and (u == 1 or (z, c) not in self.child):
                if k := spelled(c):
                    self.link[v], self.pops[v] = 1, n + k
            elif z != _DEAD:
                self.link[v], self.pops[v] = self.child[z, c], n

    def _count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be spelled."""
        v = n = 0
        child, link, pops = self.child, self.link, self.pops
        for c in word:
            while (w := child.get((v, c))) is None:
                if v == 1 and (k := self.spelled(c)):
                    n, w = n + k, 1
                    break
                n += pops[v]
                v = link[v]
                if v == _DEAD:
                    return 0
            v = w
        while v > 1:
            n += pops[v]
            v = link[v]
        return n if v == 1 else 0


@kept
def from_sentence_pieces(path: str, spell: bool = False) -> Automaton:
    """Pieces that begin with the blank sign start words, the others continue them; spell: the bare blank and byte pieces stand in where none fits."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    names = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    blank = "▁"
    if not spell:
        return Automaton({p[1:] for p in names if p[0] == blank and len(p) > 1 and blank not in p[1:]}, {p for p in names if blank not in p})
    raw = {int(model.id_to_piece(i)[3:-1], 16) for i in ids if model.is_byte(i)}

    def spelled(c: str) -> int:
        data = c.encode("utf-8", "surrogatepass")
        return len(data) if raw.issuperset(data) else 0

    # the blank sign itself is never part of a longer word
    return Automaton({p[1:] for p in names if p[0] == blank and len(p) > 1}, {p for p in names if blank not in p or p == blank}, 1 if blank in names else spelled(blank), spelled)


def token_counts(spark: SparkSession, docs: DataFrame, path: str, spell: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown; n_tokens counts each unknown word as one."""
    bounded_batches(spark)

    def run(batches):
        counts = from_sentence_pieces(path, spell).counts
        for b in batches:
            each = [[counts[w] for w in WORDS.findall(t)] for t in b.column("text").to_pylist()]
            unknown = [x.count(0) for x in each]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": pa.array(map(len, each), pa.int64()), "n_tokens": pa.array([sum(x) + u for x, u in zip(each, unknown, strict=True)], pa.int64()), "n_unknown": pa.array(unknown, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long, n_unknown long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"), public("piece_bpe_32k.model"), spell=True)
