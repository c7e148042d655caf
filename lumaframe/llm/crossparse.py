"""Language identification by cross-parsing entropy (after Ziv and Merhav, 1993).

Each language has a suffix automaton of labelled text. A whole text is parsed greedily into the longest phrases that occur in a
language's text; the language with the fewest phrases, normalised by the length of the text and the size of the automaton, wins.
Texts are lower-cased and runs of non-letters become one blank. Every letter of a language's samples is told apart.

Greedy parses that meet at the beginning of a phrase are one from there. So the pieces of a text, SEGMENT symbols each, are parsed
side by side, and each is carried on into the next until it meets that one's parse: the result is the parse of the whole text.

The fit takes a sample of `docs_per_lang` documents with an excerpt of `excerpt` characters each; these two bounds are the only ones. A model
takes about 90 bytes a sampled character (at most 2.6 MB a language by default); one of more than MODEL_BYTES is refused, not broadcast.

Edge cases: a null or empty text or one without a letter is `und` with score 0; ties go to the first language in order;
rows are handled one by one, so that repeated rows and null ids do no harm; with no labelled row at all, every text is `und`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import batches, categories, codes, give_up, slices
from .storage import unused

SEGMENT = 256
#: The most that is broadcast.
MODEL_BYTES = 1 << 30


def normal(text: str) -> str:
    """Lower case, runs of non-letters as one blank."""
    kinds, cp = categories(), np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(kinds[cp] == 1, cp, 32)
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    return cp[keep].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the start. Negative symbols separate texts: no phrase holds one."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        if c < 0:
            last = 0
            continue
        if c in to[last]:  # a generalised automaton: the extended string is already there
            q = to[last][c]
            if length[q] == length[last] + 1:
                last = q
                continue
            to.append(dict(to[q]))
            link.append(link[q])
            length.append(length[last] + 1)
            clone = len(to) - 1
            p = last
            while p != -1 and to[p].get(c) == q:
                to[p][c] = clone
                p = link[p]
            link[q] = clone
            last = clone
            continue
        to.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(to) - 1, last
        while p != -1 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p != -1:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                to.append(dict(to[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                clone = len(to) - 1
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return to


class Automaton:
    """An automaton with its rows laid over one another: the edge of state s by symbol c is at base[s] + c, if owner says so."""

    def __init__(self, to: list[dict[int, int]], symbols: int):
        used = bytearray(2 * sum(map(len, to)) + 2 * symbols + 2)
        self.base, free = np.zeros(len(to), np.int32), 0
        for s in sorted(range(len(to)), key=lambda s: -len(to[s])):
            if to[s]:
                cs = sorted(to[s])
                gaps, at = [c - cs[0] for c in cs[1:]], used.index(0, free)
                free, tries = at, 0
                while any(used[at + g] for g in gaps):  # the place of the least symbol is free
                    at, tries = used.index(0, at + 1), tries + 1
                    if at + 2 * symbols >= len(used):
                        used += bytes(len(used))
                if tries > 20:  # what lies before is too full to be worth another look
                    free = at
                for g in [0, *gaps]:
                    used[at + g] = 1
                self.base[s] = at - cs[0] + symbols  # never below 0
                if at + 2 * symbols >= len(used):
                    used += bytes(len(used))
        size = int(self.base.max(initial=0)) + symbols + 1
        self.owner, self.to, self.start = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(symbols, np.int32)
        for s, row in enumerate(to):
            for c, t in row.items():
                self.owner[self.base[s] + c], self.to[self.base[s] + c] = s, t
        for c, t in to[0].items():
            self.start[c] = t

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + self.owner.nbytes + self.to.nbytes

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins with the symbol. State 0: no phrase is open."""
        at = self.base.take(state) + symbol
        on = self.owner.take(at) == state
        return np.where(on, self.to.take(at), self.start.take(symbol)), ~on | (state == 0)


class Model:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = {k: [normal(t) for t in v] for k, v in samples.items()}
        letters = sorted({ch for v in texts.values() for t in v for ch in t} | {" "})
        self.letters = {ord(ch): i + 1 for i, ch in enumerate(letters)}  # 0: a letter in no sample
        self.automata, self.symbols, self.bits = [], [], []
        for k in self.langs:
            own = {c: i + 1 for i, c in enumerate(sorted({self.letters[ord(ch)] for t in texts[k] for ch in t}))}
            table = np.zeros(len(letters) + 1, np.int32)  # of a letter, its symbol in this language
            for c, i in own.items():
                table[c] = i
            symbols = [s for t in texts[k] for s in [*(own[self.letters[ord(ch)]] for ch in t), -1]]
            self.symbols.append(table)
            self.automata.append(Automaton(automaton(symbols), len(own) + 1))
            self.bits.append(np.log2(max(2, len(symbols))))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in self.automata) + sum(t.nbytes for t in self.symbols)

    def lookup(self) -> np.ndarray:
        """The letter of each code point, the blank for non-letters."""
        table = np.where(categories() == 1, 0, self.letters.get(32, 0)).astype(np.int32)
        for cp, c in self.letters.items():
            table[cp] = c
        return table

    def phrases(self, texts: list[str], lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by language and text, lengths, and which texts have a letter."""
        cp, starts = codes([t.lower() for t in texts])
        letter = categories()[cp] == 1
        seen = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(letter, out=seen[1:])
        has = seen[starts[1:]] > seen[starts[:-1]]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        first = starts[:-1][starts[:-1] < starts[1:]]
        keep[first] = True
        kept = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        begin = kept[starts]
        size = np.diff(begin)
        found = lookup[cp[keep]]
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        order = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[:-1][owner] + order * SEGMENT
        end = np.minimum(at + SEGMENT, begin[1:][owner])
        counts = np.array([self.parsed(a, s[found], at, end, begin[1:][owner], owner, len(texts)) for a, s in zip(self.automata, self.symbols)]).reshape(len(self.langs), len(texts))
        return counts, size, has

    @staticmethod
    def parsed(a: Automaton, symbols: np.ndarray, at: np.ndarray, end: np.ndarray, last: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Phrases of each text. Pieces begin at `at` and end at `end`, their texts end at `last`."""
        rank = np.argsort(at - end, kind="stable")  # the longest first: shorter ones drop off as they finish
        start, state, mark = at[rank], np.zeros(len(at), np.int32), np.zeros(len(symbols) + 1, bool)
        live = np.searchsorted((at - end)[rank], -np.arange(1, SEGMENT + 1), side="right")
        for t in range(SEGMENT):
            m = live[t]
            if not m:
                break
            state[:m], new = a.step(state[:m], symbols[start[:m] + t])
            mark[start[:m] + t] = new
        # carried on: until a phrase begins where one of the pieces there begins one
        over, p, met, extra = np.arange(len(at)), end[rank].copy(), np.full(len(at), -1), np.zeros(len(at), np.int64)
        limit = last[rank]
        on = np.flatnonzero(p < limit)
        over, p, state, limit = rank[on], p[on], state[on], limit[on]
        while len(over):
            state, new = a.step(state, symbols[p])
            meets = new & mark[p]
            met[over[meets]] = p[meets]
            extra[over[new & ~meets]] += 1
            p = p + 1
            on = np.flatnonzero(~meets & (p < limit))
            over, p, state, limit = over[on], p[on], state[on], limit[on]
        before = np.zeros(len(mark), np.int64)
        np.cumsum(mark[:-1], out=before[1:])
        into = np.searchsorted(at, met, side="right") - 1
        tail = extra.tolist()  # phrases from the end of each piece to the end of its text
        for i in np.flatnonzero(met >= 0)[::-1].tolist():
            j = into[i]
            tail[i] += int(before[end[j]] - before[met[i]]) + tail[j]
        out = np.zeros(texts, np.int64)
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        out[owner[heads]] = before[end[heads]] - before[at[heads]] + np.array(tail, np.int64)[heads]
        return out

    def predict(self, texts: list[str], lookup: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        counts, size, has = self.phrases(texts, lookup)
        cost = counts * np.array(self.bits)[:, None] / np.maximum(size, 1)
        best = cost.argmin(0)
        if len(self.langs) == 1:
            score = np.ones(len(texts))
        else:
            two = np.sort(cost, 0)[:2]
            score = two[1] / np.maximum(two.sum(0), 1e-12)
        return [self.langs[b] if h else "und" for b, h in zip(best, has)], np.where(has, score, 0.0)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def fit(docs: DataFrame, docs_per_lang: int = 48, excerpt: int = 600, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows with a language outside the held-out fold: per language about docs_per_lang of them by a hash, with excerpt characters each."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(doc_id)) != 2)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), (F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 40)) / (1 << 40)).alias("u"))
    shares = {r.lang: min(1.0, 2.0 * docs_per_lang / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return Model({})
    share = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col("lang")]
    at = (F.pmod(F.xxhash64("u"), F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1).cast("int")
    some = rows.where(F.col("u") < share).select("lang", "u", F.col("text").substr(at, F.lit(excerpt)).alias("text")).collect()
    by: dict[str, list] = {}
    for r in sorted(some, key=lambda r: (r.lang, r.u, r.text)):
        by.setdefault(r.lang, []).append(r.text)
    return Model({k: v[:docs_per_lang] for k, v in by.items()})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with _lang and _score added; their names end in underscores where docs has such a column."""
    if model.nbytes > MODEL_BYTES:
        raise ValueError(f"a model of {model.nbytes} bytes is too large to broadcast: fit fewer languages or shorter samples")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(unused(docs, "_lang")), F.lit(0.0).alias(unused(docs, "_score"))).schema

    def run(parts):
        give_up()
        m = shared.value
        lookup = m.lookup()
        for batch in parts:
            texts, langs, scores = batches(batch.column(text)), [], []
            for a, b in slices(texts):
                got, sure = m.predict(texts[a:b], lookup)
                langs += got
                scores += sure.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
