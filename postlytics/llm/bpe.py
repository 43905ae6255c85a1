"""Operator 6, BPE as a bounded-lookahead streaming transducer.

``lookahead(merges)`` is the number of symbols beyond which the right context can no
longer change a token. Take two words that share a prefix up to position q. Merges run
in rank order, so the first merge that differs left of q is some (u, v) across q: it
moves the point up to which both words agree to the start of u. From then on the token
at that point begins with u in either word, so the next merge (u', x) to cross it has a
higher rank and an x that begins with u. The longest chain of such merges, by the
lengths of their left parts, is found in one pass over the merge list. It holds for
proper lists (both parts of a merge are symbols or made by earlier merges).

The encoder reads a word's symbols into a window, merges it by rank, emits the tokens
that end more than the lookahead before the window's end, and goes on from the last
emitted token: what it holds does not grow with the word. (No merge crosses a token
boundary of the result, so both sides of it encode independently.)

The decoder is a state machine over token bytes: it emits the text of all complete
UTF-8 characters and holds at most three bytes of an unfinished one.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, table, whole_id, with_nulls
from postlytics.llm.tokens import BYTES, WORD, Memo, PieceMap, cuts_at_space

WINDOW = 512   # symbols merged at a time, besides the lookahead


def lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int | None:
    """Symbols of right context that decide a token; None if the list isn't proper.

    A word end marks its last symbol, so one symbol is added where there is a ``suffix``."""
    results, made = {u + v for u, v in merges}, set()
    reach: dict[str, int] = {}
    most = 0
    for u, v in merges:
        if any(t in results and t not in made for t in (u, v)):
            return None
        best = max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        here = len(u.removesuffix(suffix) if suffix else u) + best
        reach[u] = max(reach.get(u, 0), here)
        most = max(most, here)
        made.add(u + v)
    return most + (1 if suffix else 0)


def merge_window(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges, lowest rank first, leftmost first among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    if n <= 24:
        parts, get, none = symbols[:], ranks.get, 1 << 60
        pair = [get(p, none) for p in zip(parts, parts[1:])]
        while pair and (best := min(pair)) < none:
            at = pair.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = get((parts[at], parts[at + 1]), none)
            if at:
                pair[at - 1] = get((parts[at - 1], parts[at]), none)
        return parts
    parts: list[str | None] = list(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
            if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            if (r := ranks.get((a + b, parts[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, parts[k]))
        if (h := prv[i]) >= 0 and (r := ranks.get((parts[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, parts[h], a + b))
    return [p for p in parts if p is not None]


class StreamingBPE:
    """Merges of one tokenizer file as a transducer from symbols to tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "",
                 window: int = WINDOW):
        self.vocab, self.suffix, self.window = vocab, suffix, window
        self.ranks = {tuple(m): i for i, m in reversed(list(enumerate(merges)))}
        self.lookahead = lookahead([tuple(m) for m in merges], suffix)

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each emitted as soon as it is stable. A list that isn't proper
        has no bound: its words are merged whole."""
        limit = None if self.lookahead is None else self.window + self.lookahead
        held: list[str] = []
        if isinstance(symbols, str) and 0 < len(symbols) <= self.window:
            held = list(symbols)   # a whole word that fits the window
            held[-1] += self.suffix
            return iter(merge_window(held, self.ranks))
        return self._stream(iter(symbols), limit)

    def _stream(self, stream: Iterator[str], limit: int | None) -> Iterator[str]:
        held: list[str] = []
        ended = False
        while not ended:
            for s in stream:
                held.append(s)
                if limit is not None and len(held) > limit:
                    break
            else:
                ended = True
                if held and self.suffix:
                    held[-1] += self.suffix
            if ended:
                yield from merge_window(held, self.ranks)
                return
            used = 0
            for t in merge_window(held, self.ranks):
                if used + len(t) > len(held) - self.lookahead:
                    break
                used += len(t)
                yield t
            held = held[used:]


class Transducer:
    """Whole texts to ids by a tokenizer file: its normaliser and splitter, our merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = StreamingBPE(self.vocab, merges, model.get("end_of_word_suffix") or "")
        t = Tokenizer.from_file(path)
        self.normalizer, self.splitter = t.normalizer, t.pre_tokenizer
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.cut = re.compile("|".join(f"({re.escape(x)})" for x in
                                       sorted(self.special, key=len, reverse=True)) or r"(?!)")
        exact = cuts_at_space(spec)
        self.folds = exact and spec["pre_tokenizer"]["type"] != "ByteLevel"
        self.parts = PieceMap(self._ids, exact)
        self.words = Memo(lambda word: tuple(map(self.vocab.__getitem__, self.bpe.tokens(word))))
        self._word = self.words.__getitem__

    def _ids(self, piece: str) -> tuple[int, ...]:
        if "<" in piece and self.cut.search(piece):
            at, out = 0, []
            for m in self.cut.finditer(piece):
                out += [*self._plain(piece[at:m.start()]), self.special[m[0]]]
                at = m.end()
            return tuple(out + list(self._plain(piece[at:])))
        return self._plain(piece)

    def _plain(self, piece: str) -> tuple[int, ...]:
        m = WORD.fullmatch(piece) if self.folds else None
        if m:  # one word, then punctuation
            word = m[2].lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(BYTES)
            return self._word(word) + (self._word(m[3]) if m[3] else ())
        if not piece:
            return ()
        if self.normalizer is not None:
            piece = self.normalizer.normalize_str(piece)
        return tuple(chain.from_iterable(
            self._word(w) for w, _ in self.splitter.pre_tokenize_str(piece)))

    def __call__(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []


class StreamingDecoder:
    """ids -> text, bit by bit. With a byte-level decoder a token's characters are bytes;
    without any decoder (``separator`` given) tokens are their vocabulary strings with the
    separator between them."""

    def __init__(self, strings: dict[int, str], separator: str | None = None):
        back = {c: b for b, c in BYTES.items()}
        self.separator = separator
        if separator is None:
            self.bytes = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
                          for i, s in strings.items()}
        else:
            self.bytes = {i: s.encode() for i, s in strings.items()}
            self.later = {i: separator.encode() + b for i, b in self.bytes.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids: list[int]) -> str:
        """The text that these ids complete."""
        if not ids:
            return ""
        if self.separator is None:
            return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))
        head = self.bytes[ids[0]] if self.first else self.later[ids[0]]
        self.first = False
        return self.state.decode(head + b"".join(map(self.later.__getitem__, ids[1:])))

    def finish(self) -> str:
        """The text of what is left (an unfinished character becomes U+FFFD); starts anew."""
        out = self.state.decode(b"", True)
        self.state.reset()
        self.first = True
        return out


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


@cache
def decoder(path: str) -> StreamingDecoder:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    strings = {i: s for s, i in spec["model"]["vocab"].items()}
    strings |= {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
    kind = (spec.get("decoder") or {}).get("type")
    if kind not in (None, "ByteLevel"):
        raise ValueError(f"no state machine for decoder {kind}")
    return StreamingDecoder(strings, None if kind else " ")


STEP = 4096   # ids fed to the decoder at a time


def roundtrip_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256 (decimal ids joined by one blank) and
    decoded_sha256 (text decoded from the ids). Null and empty texts have no tokens and
    the digest of the empty string. Rows are independent: null or repeated ids, other
    columns and empty tables need no care; one pass, no shuffle."""
    def run(batches):
        encode, decode = transducer(tokenizer), decoder(tokenizer)
        names = {}
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                ids = encode(text)
                digest, decoded = hashlib.sha256(), hashlib.sha256()
                for lo in range(0, len(ids), STEP):
                    part = ids[lo:lo + STEP]
                    try:
                        said = " ".join(map(names.__getitem__, part))
                    except KeyError:
                        names |= {i: str(i) for i in part}
                        said = " ".join(map(names.__getitem__, part))
                    digest.update((said if lo == 0 else " " + said).encode())
                    decoded.update(decode.feed(part).encode())
                decoded.update(decode.finish().encode())
                out.append((len(ids), digest.hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pdf[["doc_id", "no_id"]].assign(n_tokens=list(n), ids_sha256=list(a),
                                         decoded_sha256=list(b))

    rows = docs.select(*whole_id(id_col), F.col(text_col).alias("text"))
    return with_nulls(rows.mapInPandas(
        run, "doc_id long, no_id boolean, n_tokens long, ids_sha256 string, decoded_sha256 string"))


@register("op6_bpe_transducer")
def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the streaming transducer and decoded by the state machine.
    SQL has no BPE: checked against the library on whole tables by the tests."""
    import public_tokenizers

    return roundtrip_digests(table(spark, sf_dir, "documents"),
                             public_tokenizers.path("word_bpe_49k.json"))
