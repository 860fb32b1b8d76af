"""SentencePiece (BPE type) encoding by a table of last tokens per prefix, and decoding.

A text's normal form is split before each run of white-space marks (and at other places
where no piece can lie, see ``_borders``): no piece of the
vocabulary holds a mark after another character (checked when the model is loaded),
so merges never cross such a border and the parts encode on their own.

Within a part every prefix has exactly one last token.  Walking the characters, an
Aho-Corasick automaton lists the pieces that end there; a piece ``t`` that starts at
``i`` is the last token of the prefix if the pair (last token of the prefix that ends
at ``i``, ``t``) is compatible: merging their joined characters by score gives the two
back.  The ids are then recovered backwards from the end of the part.  A character
outside the vocabulary is a token of its own, spelt by its byte pieces.

The pieces that hold two or more marks all have the same, lowest score, so that
their merges come last and from the left; a run of marks is merged that way.

Decoding joins the bytes of all ids of a text.  Pieces are whole characters, so the joined bytes are
valid UTF-8 exactly if each run of byte pieces is; only otherwise are runs replaced one by one.

Defined results: a null or empty text has only the end id; every other text is
encoded whole, however long.  A null id stays null, repeated rows give repeated results, an empty table
gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections import Counter
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

MARK = "▁"
#: Parts whose ids a worker remembers, and how long they are at most; beyond, it forgets those unused since it was last full.
MEMO, LONGEST = 400_000, 48
#: Pairs of tokens whose compatibility a worker remembers; each token is a piece of the vocabulary or a character.
PAIRS = 500_000


def merge(symbols: list[str], score: dict[str, float], but: str | None = None) -> list[str]:
    """The rule itself: join the adjacent pair of highest score, the leftmost first; never to ``but``."""
    sym: list[str | None] = list(symbols)
    after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i, j):
        if i >= 0 and j < len(sym) and (s := score.get(both := sym[i] + sym[j])) is not None and both != but:
            heapq.heappush(heap, (-s, i, j, both))

    for i in range(len(sym) - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if sym[i] is None or sym[j] is None or after[i] != j or sym[i] + sym[j] != both:
            continue
        sym[i], sym[j] = both, None
        after[i] = after[j]
        if after[j] < len(sym):
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [x for x in sym if x is not None]


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("expected a BPE model with byte fallback that leaves texts as they are")
        kinds = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.end = proto.trainer_spec.eos_id
        self.spelt = [b"" if i in self.control else " \u2047 ".encode() if i == self.unknown else bytes([self.id_bytes[i]]) if i in self.id_bytes else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.decimal = list(map(str, range(len(self.pieces))))
        self.marked = {i for i, p in enumerate(self.pieces) if p.startswith(MARK)}
        runs = [p for p in self.score if MARK * 2 in p]
        rest = [s for p, s in self.score.items() if MARK * 2 not in p and len(p) > 1]
        if any(MARK in p[1:] and p.strip(MARK) for p in self.score) or runs and max(self.score[p] for p in runs) >= min(rest) or len(set(rest)) < len(rest):
            raise ValueError("expected pieces with marks only in front and scores without ties")
        self.runs = {p: self.score[p] for p in runs}
        self.walk = ahocorasick.Automaton()
        self.single = {p: s for p, s in self.score.items() if p not in self.runs}
        #: Of a piece: the tokens before it whose compatibility is known; how many these are in all.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        #: When a piece is made: early ones have low numbers; and the two that make it.
        self.rank = {p: k for k, p in enumerate(sorted((p for p in self.single if len(p) > 1), key=lambda p: -self.single[p]))}
        self.halves: dict[str, tuple[str, str]] = {}
        for p in self.single:
            if len(p) > 1:
                halves = merge(list(p), self.single, but=p)
                if len(halves) > 2:
                    continue  # it never appears
                self.halves[p] = tuple(halves)
            self.walk.add_word(p, (p, len(p), self.pairs.setdefault(p, {})))
        self.walk.make_automaton()
        self.parts = self._borders()
        self.run_memo: dict[int, list[int]] = {}

    def _borders(self) -> re.Pattern:
        """A pattern of parts between which no piece can lie.

        A part begins at a run of marks, around white space that is in no piece, or at a run
        of signs that no piece has after anything but a mark or another such sign.
        """
        pairs = {(p[i], p[i + 1]) for p in self.score for i in range(len(p) - 1)}
        alone = {c for c in "\n\t\r" if not any(c in p for p in self.score)}
        signs = set(string.punctuation)
        outside = lambda: {(a, b) for a, b in pairs if b in signs and a != MARK and a not in signs}
        while many := {b for b, n in Counter(b for a, b in outside() if a.isalpha()).items() if n > 5}:
            signs -= many
        few = "".join(map(re.escape, sorted({a for a, _ in outside()})))  # a run of signs stays with these
        own = {k: "".join(map(re.escape, sorted(x))) for k, x in (("alone", alone), ("signs", signs))}
        body = f"[^{MARK}{own['alone']}{own['signs']}]"
        more = f"{body}*" + (f"(?:(?<=[{few}])[{own['signs']}]+{body}*)*" if few else "")
        lead = f"(?:{MARK}+[{own['signs']}]*|[{own['signs']}]+)" if signs else f"{MARK}+"
        return re.compile(f"{lead}{more}|{body}{more}" + (f"|[{own['alone']}]+" if alone else ""))

    def compatible(self, left: str, right: str) -> bool:
        own = self.pairs[right]
        if (known := own.get(left)) is None:
            if self.n_pairs > PAIRS:
                for x in self.pairs.values():
                    x.clear()
                self.n_pairs = 0
            self.n_pairs += 1
            known = own[left] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives the two back.

        Their merges are undone from the last one on. Between two steps the symbols beside the border must
        not be joined before the next of them is used up, that is before ``limit``.
        """
        rank, limit = self.rank, len(self.rank)
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                limit, left = a, self.halves[left][1]
            elif b >= 0:  # of equal pieces the right one is made last, and after a pair across the border
                limit, right = b + 1, self.halves[right][0]
            else:
                return True

    def _last(self, part: str) -> list[str | None]:
        """Of each prefix of a part with one mark at most its last piece; None for a character outside the vocabulary."""
        last: list[str | None] = [None] * (len(part) + 1)
        for at, (piece, size, known) in self.walk.iter(part):  # of those that end at one character, the longest first
            if last[at + 1] is None:
                i = at + 1 - size
                if i == 0:
                    last[at + 1] = piece
                else:
                    left = last[i] or part[i - 1]
                    ok = known.get(left)
                    if ok or ok is None and self.compatible(left, piece):
                        last[at + 1] = piece
        return last

    def tokens(self, part: str) -> list[str]:
        """The pieces of a part with one mark at most, and single characters outside the vocabulary."""
        last = self._last(part)
        out, at = [], len(part)
        while at:
            token = last[at] or part[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def size(self, part: str) -> int:
        """The number of ids of a part."""
        if part.startswith(MARK * 2):
            return len(self.part(part))
        last, n, at = self._last(part), 0, len(part)
        while at:
            if token := last[at]:
                n += 1
                at -= len(token)
            else:
                at -= 1
                n += len(part[at].encode())
        return n

    def spell(self, tokens: list[str]) -> list[int]:
        out = list(map(self.ids.get, tokens))
        if None not in out:
            return out
        out = []
        for t in tokens:
            if (i := self.ids.get(t)) is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in t.encode())
        return out

    def part(self, part: str) -> list[int]:
        """The ids of a part: marks, then anything else."""
        body = part.lstrip(MARK)
        n = len(part) - len(body)
        if n <= 1:
            return self.spell(self.tokens(part))
        inner = self.tokens(MARK + body) if body else [MARK]
        if inner[0] == MARK:
            inner = inner[1:]
        else:
            n -= 1
        if n not in self.run_memo:
            self.run_memo[n] = self.spell(merge([MARK] * n, self.runs))
        return self.run_memo[n] + self.spell(inner)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split(text):
            out += self.part(part)
        return [*out, self.end]

    def split(self, text: str) -> list[str]:
        return self.parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become blanks, the first one goes, control ids are silent."""
        raw = b"".join(map(self.spelt.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._in_runs(ids)
        return text[1:] if next((i for i in ids if i not in self.control), None) in self.marked else text

    def _in_runs(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.id_bytes:
                run.append(self.id_bytes[i])
            else:
                out += [utf8(bytes(run)), self.spelt[i].decode()]
                run.clear()
        return "".join([*out, utf8(bytes(run))])


def utf8(raw: bytes) -> str:
    """Bytes that aren't part of a character count as one replacement each."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


class Encoder:
    """A codec with a worker's memory of short parts."""

    def __init__(self, codec: Codec):
        self.codec, self.memo, self.old = codec, {}, {}
        self.counts: dict[str, int] = {}
        self.old_counts: dict[str, int] = {}

    def _ids(self, part: str) -> list[int]:
        if (found := self.memo.get(part)) is not None:
            return found
        found = self.old.get(part)
        if found is None:
            found = self.codec.part(part)
        if len(part) <= LONGEST:
            if len(self.memo) > MEMO // 2:
                self.old, self.memo = self.memo, {}
            self.memo[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        parts = self.codec.split(text)
        known = list(map(self.memo.get, parts))
        if None in known:
            known = list(map(self._ids, parts))
        known.append((self.codec.end,))
        return list(chain.from_iterable(known))

    def _count(self, part: str) -> int:
        if (found := self.counts.get(part)) is not None:
            return found
        found = self.old_counts.get(part)
        if found is None:
            found = self.codec.size(part)
        if len(part) <= LONGEST:
            if len(self.counts) >= MEMO:
                self.old_counts, self.counts = self.counts, {}
            self.counts[part] = found
        return found

    def count(self, text: str) -> int:
        """The number of ids; of parts only their number is remembered."""
        parts = self.codec.split(text)
        known = list(map(self.counts.get, parts))
        new = [p for p, n in zip(parts, known, strict=True) if n is None] if None in known else ()
        return sum(filter(None, known)) + sum(map(self._count, new)) + 1


def encoder(model: bytes) -> Encoder:
    """This worker's encoder of a model."""
    cache = common.worker_cache("sentencepiece")
    key = hashlib.sha256(model).digest()
    if key not in cache:
        cache[key] = Encoder(Codec(model))
    return cache[key]


def _rows(batches, model: bytes):
    own = encoder(model)
    for pdf in batches:
        coded = list(map(own.encode, pdf["text"]))
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "n_tokens": list(map(len, coded)),
                "ids": [" ".join(map(own.codec.decimal.__getitem__, x)) for x in coded],
                "decoded": list(map(own.codec.decode, coded)),
            }
        )


def codec_table(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (decimal, one blank between), decoded text."""
    return common.frames(common.texts(docs), lambda it: _rows(it, model), "doc_id long, n_tokens long, ids string, decoded string")


def _digests(batches, model: bytes):
    for pdf in _rows(batches, model):
        sha = [[hashlib.sha256(x.encode()).hexdigest() for x in pdf[c]] for c in ("ids", "decoded")]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pdf["n_tokens"], "ids_sha256": sha[0], "decoded_sha256": sha[1]})


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are taken in the workers, so that ids and texts need not pass to the JVM."""
    model = default_model()
    docs = common.texts(common.table(spark, sf_dir, "documents"))
    return common.frames(docs, lambda it: _digests(it, model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
