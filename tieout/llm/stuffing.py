"""Pages of repeated keywords, link lists, menus and product tags rather than sentences.

Every page is read in stretches of ``STRETCH`` tokens, so stretches of all pages are of comparable
length and a page that wraps spam in sentences, or sentences in spam, is judged by how much of it is
which. A language is what the corpus shows it to be: per script and declared language the words that many
stretches hold are counted in a first pass. Those spread as evenly as chance would spread them, mostly where
sentences end, are its prose words; those that come in bursts or in lists are its keywords. In a second pass each stretch gets the language whose
words of both kinds it holds most of, the rank-frequency curve of its words (slope, residual, and length in
ranks a word), and its divergence: the share of prose words it lacks. Centre and spread of each come from all
stretches of a language, as medians and distances of quartiles, which the spam in the corpus doesn't move much.
A stretch is stuffed if

* its curve is far shorter than prose's, or steeper, or so far off a straight line, with few different words,
* most of it is bare links without sentences around them, or
* it diverges from the prose of its language and has hardly any sentence ends (menus, tags, lists), or is items
  between separators or on lines of their own without any sentence end. Where the corpus doesn't know the language
  (few of the words are frequent in any) nothing diverges, so prose in an unknown language isn't taken for a list.

Tables of figures, record layouts (field codes with positions) and terse notes (short clauses, each
with its full stop, without repetition) aren't stuffed. A page is found if more than ``SHARE`` of its
tokens lie in stuffed stretches.

A text is one row, so its stretches are counted where it is read, in Arrow batches: no text is shuffled. The curve is
fitted from sums over ranks (tabulated for the many words that occur once) instead of by windows over one
row a word, which cost over a thousand CPU seconds a GB. Nothing is cut or sampled: all tokens of all texts are read.

Defined results: null, empty and blank texts aren't found; texts of fewer than ``LEAST`` tokens are
too short to be a list and aren't found; scripts written without spaces are read character by
character; with few stretches to compare with, limits lie nearer to those given here (``PRIOR``).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from functools import lru_cache
from math import log, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stage

STRETCH, SHARE, LEAST = 40, 0.27, 12
#: Stretches of comparison that what is assumed beforehand counts as.
PRIOR = 500
#: A language is one that at least this share of all stretches declares; its words are those in at least this share of its stretches: at most 200 languages of 4,000 words.
LANGUAGE_SHARE, WORD_SHARE = 0.005, 0.01
#: A word is a keyword if, where it occurs, it occurs so many times as often as chance would have it.
BURST = 1.2
#: Least share of words a stretch shares with a language for it to be known.
KNOWN = 0.2
SPREADS = 3.0

ENDS = ".!?…。！？।؟۔"
SEPARATORS = ",;|•·»>→/，、；\ue000"
#: Prose words of three languages, assumed until a corpus shows its own. Fixed values.
ASSUMED = {
    "en": "the of and to a in for is on from that with as had was at no one before out it we not you our can be by whether should when so which if may never does since why until yet but up after this are or an has have they their there will would than more into its were been all only who what how your",
    "de": "die das der nach nicht wurde vor von im in seit noch dem ist über keine warum konnte zur weil auf wenn ein eine mehr für doch jede aus bitte es sie nur einen uns wer dass am und den des mit zu zum oder auch sich als an war wird sind haben hat durch bei unter wir ihr ihre",
    "fr": "le la de l a n pas à avant depuis une d ont que ne été du des après encore plus en chaque sa car était aux si personne doit pour pourquoi dans nous toujours est avec votre les vers il y et un au qui sur par se ce cette mais ou où son ses leur leurs sont sans sous même comme on elle",
}

_LINK = ("http://", "https://", "www.")
_CODE = re.compile(r"^[A-Z]{5,8}:?$")
_LETTERS = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f\u0900-\u0df2])+")
_LINES = re.compile(r"\s*\n\s*")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
#: Ranks whose logarithms and their sums are kept; a plan of work only, those beyond are worked out alike.
_KEPT = 4 * STRETCH
_LOGS = [0.0, *[log(i) for i in range(1, _KEPT)]]
_SUM, _SQUARES = [0.0], [0.0]
for _x in _LOGS[1:]:
    _SUM.append(_SUM[-1] + _x)
    _SQUARES.append(_SQUARES[-1] + _x * _x)


def _log(rank: int) -> float:
    return _LOGS[rank] if rank < _KEPT else log(rank)


def _sums(ranks: int) -> tuple[float, float]:
    """Sums of the logarithms of the ranks from 1 on, and of their squares."""
    k = min(ranks, _KEPT - 1)
    s, q = _SUM[k], _SQUARES[k]
    for i in range(_KEPT, ranks + 1):
        x = log(i)
        s, q = s + x, q + x * x
    return s, q


def tokens(text: str) -> list[str]:
    """Parted by blanks; characters one by one where a script has none between words. A line's last token keeps a mark of its end."""
    out = _LINES.sub("\ue000 ", text.strip()).split()
    if _UNSPACED.search(text):
        out = [c for t in out for c in (_characters(t) if _UNSPACED.search(t) else (t,))]
    return out


def _characters(token: str) -> list[str]:
    """Characters of an unspaced token; marks stay with the one before, other letters and digits together."""
    return re.findall(r"(?:[^\W\d_a-zA-Z]|[a-zA-Z0-9]+)[^\w]*|[^\w]+", token) or [token]


def stretches(toks: list[str]) -> list[list[str]]:
    n = max(1, (len(toks) + STRETCH // 2) // STRETCH)
    return [toks[i * STRETCH : (i + 1) * STRETCH if i < n - 1 else len(toks)] for i in range(n)]


class _Kinds(dict):
    """Tokens and their kinds, emptied when it holds too many."""

    def __missing__(self, token: str) -> tuple[str, bool, bool, tuple[str, ...]]:
        if len(self) > 500_000:
            self.clear()
        out = self[token] = kind(token)
        return out


KINDS = _Kinds()


def kind(token: str) -> tuple[str, bool, bool, tuple[str, ...]]:
    """(link, figure, code or empty; ends a sentence; separates items; words of letters, none in links and figures)."""
    low = token.lower()
    closed = token.rstrip("'\")]”»\ue000")
    end = closed[-1:] in ENDS and closed != ""
    apart = token[-1:] in SEPARATORS
    if any(x in low for x in _LINK):
        return "link", end, apart, ()
    if any(c.isdigit() for c in token):
        return "figure", end, apart, ()
    return "code" if _CODE.match(token.rstrip("\ue000")) else "", end, apart, tuple(_LETTERS.findall(low))


@lru_cache(maxsize=4_096)
def _script(char: str) -> str:
    return unicodedata.name(char, "?").split(" ")[0]


_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u2c00-\ufaff]")


def script(words: Iterable[str]) -> str:
    """The script of most words, by their first letters."""
    if not _BEYOND_LATIN.search("".join(words)):
        return "LATIN" if words else ""
    c = Counter(_script(w[0]) for w in words)
    return max(c, key=lambda s: (c[s], s)) if c else ""


def _words(toks: list[str]) -> list[str]:
    return [w for t in toks for w in KINDS[t][3]]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(language, word, held, total, ended): in how many stretches of comparable length a word is, how often, and in how many beside
    a sentence end; word '' counts the stretches."""
    for pdf in batches:
        held: dict[str, Counter] = {}
        total: dict[str, Counter] = {}
        ended: dict[str, Counter] = {}
        for text, lang in zip(pdf["text"], pdf["lang"]):
            for s in stretches(tokens(text)):
                w = _words(s)
                if len(w) >= STRETCH // 2:
                    once = set(w)
                    g = f"{script(once)}:{lang or ''}"
                    if g not in held:
                        held[g], total[g], ended[g] = Counter(), Counter(), Counter()
                    held[g].update(once)
                    held[g][""] += 1
                    total[g].update(w)
                    if any(KINDS[t][1] for t in s):
                        ended[g].update(once)
        out = [(g, w, n, total[g][w], ended[g][w]) for g, h in held.items() for w, n in h.items()]
        yield pd.DataFrame(out, columns=["language", "word", "held", "total", "ended"])


def languages(docs: DataFrame) -> dict[str, tuple[frozenset[str], frozenset[str]]]:
    """(prose words, keywords) of each language the corpus shows. ``docs``: (text, lang). Bounded by the two shares."""
    c = docs.mapInPandas(_count_words, "language string, word string, held long, total long, ended long").groupBy("language", "word").agg(*[F.sum(x).alias(x) for x in ("held", "total", "ended")])
    c = stage(c.where(F.length("word") < 40))
    sizes = {r.language: r.held for r in c.where("word = ''").collect()}  # one row a script and declared language
    out: dict[str, dict[str, list[float]]] = {}
    for k, words in ASSUMED.items():
        out[f"LATIN:{k}"] = {w: [0.2 * PRIOR, 0.22 * PRIOR, 0.2 * PRIOR] for w in words.split()}
    whole = sum(sizes.values())
    shown = [g for g, n in sizes.items() if n >= LANGUAGE_SHARE * whole]
    named = {g.split(":")[0] for g in [*out, *shown] if not g.endswith(":")}
    shown = [g for g in shown if not g.endswith(":") or g.split(":")[0] not in named]  # undeclared texts are of several languages
    limit = F.lit(None).cast("double")
    for g in shown:
        limit = F.when(F.col("language") == g, WORD_SHARE * sizes[g]).otherwise(limit)
    for r in c.where((F.col("word") != "") & (F.col("held") >= limit)).collect():
        was = out.setdefault(r.language, {}).get(r.word, (0.0, 0.0, 0.0))
        out[r.language][r.word] = [x + y for x, y in zip(was, (r.held, r.total, r.ended))]
    found, most = {}, {}
    for g, words in out.items():
        n = sizes.get(g, 0) + PRIOR
        prose, keys = set(), set()
        for w, (held_, total_, ended_) in words.items():
            p = held_ / n
            if p >= WORD_SHARE:
                even = total_ / held_ <= BURST * -log(max(1 - p, 1e-9)) / p or p > 0.5
                (prose if even and ended_ >= 0.5 * held_ else keys).add(w)
                most[w] = max(most.get(w, (0.0, "")), (held_, g))
        found[g] = (prose, keys)
    # a word belongs to the language it is most frequent in; texts in another one than declared bring it into others
    foreign = {w: most[w][1] for _, keys in found.values() for w in keys if w in found[most[w][1]][1]}
    return {g: (frozenset(w for w in prose if foreign.get(w, g) == g), frozenset(keys | {w for w in prose if foreign.get(w, g) != g})) for g, (prose, keys) in found.items()}


def curve(counts: Collection[int]) -> tuple[float, float, float]:
    """Slope, residual and length (ranks a word) of a rank-frequency curve on logarithms; ``counts`` in any order."""
    n = len(counts)
    y = sorted((c for c in counts if c > 1), reverse=True)
    ly = [log(c) for c in y]
    (sx, sxx), sy = _sums(n), sum(ly)
    sxy = sum(_log(i) * v for i, v in enumerate(ly, 1))
    dxx, dxy, dyy = sxx - sx * sx / max(n, 1), sxy - sx * sy / max(n, 1), sum(v * v for v in ly) - sy * sy / max(n, 1)
    slope = dxy / dxx if dxx > 0 else 0.0
    return slope, sqrt(max(dyy - slope * dxy, 0.0) / max(n, 1)), n / max(sum(counts), 1)


_CURVES = "doc_id {}, stretch int, language string, size int, links int, figures int, codes int, ends int, apart int, words int, prose double, known double, slope double, residual double, length double"


def _curves(known: dict[str, tuple[frozenset[str], frozenset[str]]]):
    names = [c.split()[0] for c in _CURVES.split(", ")]
    order = sorted(known)
    of_word: dict[str, list[tuple[int, int]]] = {}  # word -> (language, 0 if a prose word, 1 if a keyword)
    for i, g in enumerate(order):
        for part in (0, 1):
            for w in known[g][part]:
                of_word.setdefault(w, []).append((i, part))
    own = {f"{g.split(':')[0]}": [] for g in order}
    for i, g in enumerate(order):
        own[g.split(":")[0]].append(i)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = (0, 0, -1)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                toks = tokens(text)
                if not toks:
                    continue
                for i, s in enumerate(stretches(toks)):
                    kinds = [KINDS[t] for t in s]
                    counts = Counter([w for k in kinds for w in k[3]])
                    held = [[0, 0] for _ in order]
                    for w in counts.keys() & of_word.keys():
                        n = counts[w]
                        for j, part in of_word[w]:
                            held[j][part] += n
                    words = counts.total()
                    in_prose, in_keys, best = max(((*held[j], j) for j in own.get(script(counts), ())), key=lambda x: (x[0] + x[1], x), default=none)
                    links = figures = codes = ends = apart = 0
                    for k, end, sep, _ in kinds:
                        ends += end
                        apart += sep
                        if k:
                            links += k == "link"
                            figures += k == "figure"
                            codes += k == "code"
                    some = max(words, 1)
                    out.append((doc, i, order[best] if best >= 0 else "", len(s), links, figures, codes, ends, apart, words, in_prose / some, (in_prose + in_keys) / some, *curve(counts.values())))
            yield pd.DataFrame(out, columns=names)

    return run


def curves(docs: DataFrame, known: dict[str, tuple[frozenset[str], frozenset[str]]]) -> DataFrame:
    """One row a stretch of ``docs`` (doc_id, text): what its tokens are and its rank-frequency curve."""
    return docs.mapInPandas(_curves(known), _CURVES.format(dict(docs.dtypes)["doc_id"]))


#: Assumed centres of prose, until a corpus shows its own: share of prose words, length, slope and residual of the curve.
CENTRES = {"prose": 0.42, "length": 0.8, "slope": -0.33, "residual": 0.22}
#: A stretch diverges below this share of the centre; beside that its curve is extreme at these multiples of the centres, and alone below ``SHORT``.
DIVERGENT, SHORTER, STEEPER, SHORT = 0.65, 0.75, 2.4, 0.45


def prose_reference(stretches_: DataFrame) -> DataFrame:
    """One row a language: centres and the residual's spread, of all stretches of comparable length, drawn towards what is assumed by PRIOR."""
    full = stretches_.where(F.col("words") >= STRETCH // 2)
    n = F.count(F.lit(1))
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.5), F.lit(0.75)), F.lit(1000))
    drawn = lambda value, assumed: (value * n + assumed * PRIOR) / (n + PRIOR)
    return full.groupBy("language").agg(*[drawn(quartiles(c)[0], v).alias(f"{c}_centre") for c, v in CENTRES.items()], drawn(quartiles("residual")[1] - quartiles("residual")[0], 0.05).alias("residual_spread"))


def judged(stretches_: DataFrame, reference: DataFrame) -> DataFrame:
    """Stretches with ``stuffed``: the reason, or null."""
    s = stretches_.join(F.broadcast(reference), "language", "left")  # one row a language, at most 203
    centre = lambda c: F.coalesce(f"{c}_centre", F.lit(CENTRES[c]))
    of_all = lambda c: F.col(c) / F.col("size")
    table = (of_all("codes") >= 0.08) & (of_all("figures") >= 0.12) | (of_all("figures") > 0.45)
    known = F.col("known") >= KNOWN
    diverges = known & (F.col("prose") < DIVERGENT * centre("prose"))
    links = (of_all("links") >= 0.2) & (diverges | ~known & (of_all("links") >= 0.5))
    extreme = (F.col("length") < SHORTER * centre("length")) | (F.col("slope") < STEEPER * centre("slope")) | (F.col("residual") > centre("residual") + SPREADS * 1.4826 * F.coalesce("residual_spread", F.lit(0.05)))
    repeated = (F.col("words") >= LEAST) & (diverges & extreme | (F.col("length") < SHORT * centre("length")))
    long_enough = F.col("size") >= LEAST
    items = (F.col("ends") == 0) & (of_all("apart") >= 0.3) & (of_all("figures") < 0.2)
    listed = long_enough & (diverges & (of_all("ends") < 0.04) | items)
    return s.withColumn("stuffed", F.when(links, "links").when(table, None).when(repeated, "repetition").when(listed, "list"))


def pages(stretches_: DataFrame) -> DataFrame:
    """(doc_id, tokens, stuffed_share, reason) of every page with a token."""
    bad = F.col("stuffed").isNotNull()
    return stretches_.groupBy("doc_id").agg(F.sum("size").alias("tokens"), (F.coalesce(F.sum(F.when(bad, F.col("size"))), F.lit(0)) / F.sum("size")).alias("stuffed_share"), F.min("stuffed").alias("reason"))


def stuffed_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """(doc_id, tokens, stuffed_share, reason) of the pages found. Without ``lang_col`` a script is one language."""
    lang: Column = F.lower(F.trim(F.col(lang_col).cast("string"))) if lang_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")).where(F.col("text").rlike(r"\S"))
    s = stage(curves(d.select("doc_id", "text"), languages(d.select("text", "lang"))))  # about 100 bytes per 40 tokens; read for the reference and for the verdict
    return pages(judged(s, prose_reference(s))).where((F.col("stuffed_share") > SHARE) & (F.col("tokens") >= LEAST))
