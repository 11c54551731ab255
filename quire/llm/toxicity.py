"""Abusive, hateful and sexually explicit passages by maximum-scoring segments over token log-odds.

Tokens are words and pairs of words, and pairs and triples of Han characters. Their log-odds of standing in a
passage of a kind come from labelled documents, with informative Dirichlet priors: a background prior from
the counts over all documents, and a small seed list that counts as a few sightings. As labels are given to whole
documents, the counts of a labelled document are moved, round by round, to the segments that score in it.
A linear scan then finds every maximal segment (Ruzzo and Tompa 1999); extreme-value statistics of
segment scores (Karlin and Altschul 1990) turn the scores of a document into one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.canonical import canonical
from quire.session import cut

FUNCTION_WORDS = {"en": (" the ", " of ", " and ", " you ", " in "), "fr": (" les ", " des ", " la ", " le ", " tu "), "de": (" die ", " der ", " und ", " den ", " du ")}
LANGUAGES = ("en", "fr", "de", "zh")
KINDS = ("abusive", "hateful", "sexual")
# Besides, all kinds together, whose weights pool the evidence of all labels.
MODELS = (*KINDS, "toxic")
LABELLED_ROWS = 10_000
PRIOR = 20_000.0
PRIOR_LEAST = 0.1
SEED_SIGHTINGS = 10.0
ROUNDS = 4
DRIFT = -0.7
PASSAGE = 4.0
# Different documents labelled as of some kind that a token needs to be evidence at all: raters err, and one text proves nothing.
SUPPORT = 2
# A text is found if less than one harmless one in a hundred would score as it does.
THRESHOLD = 2.0
# Seed words, and phrases that count only as a whole, as a prior; in the order English, German, French, Chinese.
SEEDS = {
    "abusive": "idiot idiots moron morons asshole bastard bitch scumbag dumbass halfwit imbecile clown jerk loser cretin dickhead ambulance vollidiot arschloch drecksack versager trottel dummkopf idiot hurensohn mistkerl verpiss connard connasse crétin imbécile abruti salaud ordure débile 傻逼 白痴 脑残 混蛋 王八蛋 人渣 废物 蠢货 贱人 狗东西 滚蛋 去死 闭嘴 滚远点 臭嘴 你妈 打断你的腿 扇烂 烧了你",
    "hateful": "subhuman vermin ungeziefer untermenschen vermine sous-hommes 血统低劣 不许他们 天生就是贼 根本不配 都该消失 都是害虫 赶出去 世界会更干净 看到他们就恶心",
    "sexual": "fuck fucked naked nude nudes horny orgasm porn porno blowjob cum ficken gefickt nackt geil pornos orgasmus baise baiser nue nues porno orgasme bite 裸照 裸聊 约炮 黄片 性爱 高潮不断 呻吟 赤身 脱光 一夜情 激情视频 无码",
}
SEED_PHRASES = {
    "abusive": "shut up|go to hell|get lost|choke on|kill yourself|make me sick|break your|burn your|find you|where you live|halt die klappe|die klappe|fahr zur hölle|sonst wohin|ich finde dich|ta gueule|va au diable|ferme la|je vais te",
    "hateful": "born thieves|go back where|back where they came|not real humans|did not exist|stink and they lie|no decent person|better off if all|keep them away|never trust|gehören vertrieben|wäre die stadt sauberer|geborene diebe|ne méritent pas de vivre|voleurs nés",
    "sexual": "lick her|strip her|so wet|without clothes|begged him|zog sich ganz aus|toute nue",
}
LEET = str.maketrans("013457@$!|", "oieastasil")
# Full-width signs that cut sentences as the ordinary ones do need no other form.
NEEDS_FORM = re.compile("[\\xad\\u0300-\\u036f\\u0370-\\u052f\\u200b-\\u200f\\u2060\\ufeff\\uff02-\\uff07\\uff0a\\uff0b\\uff0d-\\uff19\\uff1c-\\uff1e\\uff20-\\uff5e\\u0530-\\u058f\\u2010\\u2011]|\\uff01(?=[A-Za-z])")
SPACED = re.compile(r"(?<![^\W_])(?:[a-zß-ÿœ][ .\-_*·]{1,2}){2,}[a-zß-ÿœ]{1,3}(?![^\W_])")
LEETED = re.compile(r"(?<![\w@$!-])(?=[a-zß-ÿ0-9@$!|]*[a-zß-ÿ])(?=[a-zß-ÿ0-9@$!|]*[0-9@$!|])[a-zß-ÿ0-9@$|](?:[a-zß-ÿ0-9@$|]|!(?=[a-z]))+(?![\w-])")
MAY_BE_SPACED = re.compile(r"[a-zß-ÿ][ .\-_*·]{1,2}[a-zß-ÿ][ .\-_*·]{1,2}[a-zß-ÿ]")
MAY_BE_LEETED = re.compile(r"[0-9@$|!](?:(?=[a-zß-ÿ])|(?<=[a-zß-ÿ].))")
TRIPLES = ahocorasick.Automaton()
for _c in map(chr, [*range(ord("a"), ord("z") + 1), *range(ord("ß"), ord("ÿ") + 1)]):
    TRIPLES.add_word(_c * 3, 1)
TRIPLES.make_automaton()
UNIT = re.compile(r"[a-zß-ÿœ]+|[一-鿿]+")
HAN_RUN = re.compile("[一-鿿]+")
STRETCHED = re.compile(r"([a-zß-ÿ])\1{2,}")
HAN_GAP = re.compile(r"(?<=[一-鿿])[ *·.\-_、](?=[一-鿿])")
MASKED = re.compile(r"(?<=[a-zß-ÿ])\*+|(?<=[一-鿿])\*")
WORD = re.compile(r"[a-zß-ÿœ]+|[一-鿿]+|[.!?。！？；;]+|\n+|[^\sa-zß-ÿœ一-鿿.!?。！？；;]+")
END = re.compile(r"[.!?。！？；;\n]")
PIECE = re.compile(r"[^ \t\n一-鿿]+|[一-鿿]+|\t")
# Signs that words stand on both sides of as if there were nothing.
SKIPPED = "、·-_'’"
MASK = "‹mask›"


def plain(text: str) -> str:
    """Lower case, with look-alikes, spelled-out letters, digits for letters and masks undone."""
    t = (canonical(text) if NEEDS_FORM.search(text) else text).lower()
    if "*" in t:
        t = HAN_GAP.sub(lambda m: "" if m[0] in "*" else m[0], t)
        t = MASKED.sub(" " + MASK + " ", t)
    if MAY_BE_SPACED.search(t):
        t = SPACED.sub(lambda m: re.sub(r"[^\w]", "", m[0]) if len(m[0]) > 5 else m[0], t)
    if next(TRIPLES.iter(t), None):
        t = STRETCHED.sub(r"\1", t)
    if MAY_BE_LEETED.search(t):
        t = LEETED.sub(lambda m: m[0].translate(LEET), t)
    return t



def sentences(text: str) -> Iterator[list[str]]:
    """Lists of words and Han characters of each sentence of a plain text; a comma or the like is kept as ','."""
    now: list[str] = []
    for m in WORD.finditer(text):
        w = m[0]
        if END.match(w):
            if now:
                yield now
            now = []
        elif "一" <= w[0] <= "鿿":
            now += w
        elif w[0].isalpha() or w == MASK:
            now.append(w)
        elif w in SKIPPED and now:
            continue
        elif now and now[-1] != ",":
            now.append(",")
    if now:
        yield now


def tokens(words: list[str]) -> list[list[str]]:
    """Tokens that end at each position: the word itself, and it with the one or two before."""
    out = []
    for i, w in enumerate(words):
        if w == ",":
            out.append([])
            continue
        han = "一" <= w[0] <= "鿿"
        here = [] if han else [w]
        if i and words[i - 1] != ",":
            gap = "" if han else " "
            here.append(words[i - 1] + gap + w)
            if i > 1 and words[i - 2] != ",":
                here.append(words[i - 2] + gap + words[i - 1] + gap + w)
        out.append(here)
    return out


def seed_tokens(kind: str) -> set[str]:
    """The seeds as the tokens that the scan sees: single words, and the pairs and triples of phrases."""
    out: set[str] = set()
    if kind == "toxic":
        return out.union(*(seed_tokens(k) for k in KINDS))
    for seed in SEEDS[kind].split(" "):
        for words in sentences(seed):
            out.update(t for here in tokens(words) for t in here)
    for phrase in SEED_PHRASES[kind].split("|"):
        for words in sentences(phrase):
            out.update(t for here in tokens(words) for t in here if t not in words)
    return {t for t in out if len(t) > 1}


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time."""
    total = 0.0
    found: list[list] = []  # start, end, sum before, sum after
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        seg = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= seg[2]:
                j -= 1
            if j < 0 or found[j][3] >= seg[3]:
                found.append(seg)
                break
            seg = [found[j][0], i + 1, found[j][2], total]
            del found[j:]
    return [(a, b, y - x) for a, b, x, y in found]


@dataclass
class Scorer:
    """Weights by kind of the tokens that tell; a position without any weighs `drift`.

    lam, worked out from the corpus, and k calibrate segment scores; k stands above what harmless labelled documents show
    (0.0002 to 0.002), so that chances are rather too large than too small. To the
    positions of a text those of a usual one are added, as else hardly anything would be by chance in a text of one sentence.
    """

    weights: dict[str, dict[str, float]]
    lam: dict[str, float]
    calls: Matcher | None = None
    k: float = 0.1
    usual: float = 0.0

    def scan(self, here: list[list[str]], kind: str) -> list[tuple[int, int, float]]:
        """Maximal segments of a sentence, given its tokens; a position weighs as the most telling token that ends there."""
        w = self.weights[kind]
        scores = []
        for ts in here:
            known = [w[t] for t in ts if t in w]
            scores.append(max(known) if known else DRIFT)
        return segments(scores) if max(scores, default=0) > 0 else []

    def score(self, text: str | None) -> dict[str, float]:
        """-log10 of the chance that a harmless text of this length has such segments, by kind; 0 for null and empty."""
        out = dict.fromkeys(MODELS, 0.0)
        if not text:
            return out
        t = plain(text)
        _, n, han = extent(t)
        sents = [tokens(words) for words in (self.calls.sentences(t, han) if self.calls else sentences(t))]
        if not sents:
            return out
        n += self.usual
        for kind in MODELS:
            least = math.log(max(1.0, self.k * n))
            lam = self.lam[kind]
            total = sum(max(0.0, lam * s - least) for here in sents for _, _, s in self.scan(here, kind))
            out[kind] = round(total / math.log(10), 6)
        return out


Cut = tuple[str, list[list[list[str]]]]


def cut_up(text: str) -> Cut:
    """Language of a text, and the tokens that end at each position of each of its sentences."""
    t = plain(text)
    return extent(t)[0], [tokens(words) for words in sentences(t)]


def extent(t: str) -> tuple[str, int, bool]:
    """(language group, positions, whether it has Han characters) of a plain text: by script and function words, and words plus Han characters.

    Rates of tokens are compared within a language group.
    """
    han = sum(map(len, HAN_RUN.findall(t))) if not t.isascii() else 0
    n = han + t.count(" ") + 1
    if han > 0.3 * n:
        return "zh", n, True
    return max(FUNCTION_WORDS, key=lambda k: sum(t.count(w) for w in FUNCTION_WORDS[k])), n, han > 0


GAP = re.compile(r"[^a-zß-ÿœ一-鿿 ][^a-zß-ÿœ一-鿿]*| [^a-zß-ÿœ一-鿿]+")
LATIN = re.compile("[a-zß-ÿœ]+")
HAN_SPACE = re.compile(" (?:(?<=[一-鿿\\t\\n] )|(?<=^ ))(?=[一-鿿\\t\\n])")
SCRIPTS_MEET = re.compile("(?<=[一-鿿]) ?(?=[^ 一-鿿])|(?<=[^ 一-鿿])(?=[一-鿿])")


def between(run: str) -> str:
    """What stands between two words for a run of other characters: ends of sentences, commas, words of other scripts, or nothing but space."""
    out: list[str] = []
    for w in WORD.findall(run):
        if END.match(w):
            if out[-1:] == ["\t"]:
                out.pop()
            out.append("\n")
        elif w[0].isalpha():
            out.append(w)
        elif w not in SKIPPED and out[-1:] not in (["\t"], ["\n"]):
            out.append("\t")
    return " ".join(["", *out, ""]) if out else " "


gap = lru_cache(maxsize=100_000)(between)


def joined(text: str, han: bool = True) -> str:
    """A plain text with one space on both sides of each word, none between Han characters, tabs for commas and line ends for
    ends of sentences: the tokens of sentences() are its parts that begin and end so. han=False: it has no Han character."""
    t = " " + GAP.sub(lambda m: gap(m[0]) if m.end() - m.start() < 50 else between(m[0]), text) + " "
    if not han or t.isascii():
        return t
    return HAN_SPACE.sub("", LATIN.sub(r" \g<0> ", t).replace("   ", " ").replace("  ", " "))


def pattern(token: str) -> str:
    """How a token stands in a joined text."""
    p = SCRIPTS_MEET.sub(" ", token)
    return (p if HAN_RUN.match(p) else " " + p) + ("" if HAN_RUN.match(p[-1]) else " ")


def words_of(sentence: str) -> list[str]:
    """The words and Han characters of a sentence of a joined text, ',' for its tabs."""
    return [x for w in PIECE.findall(sentence) for x in (w if HAN_RUN.match(w) else ("," if w == "\t" else w,))]


class Matcher:
    """Finds the tokens of a set in joined texts, all of them and no other, in one pass over the characters.

    What is no token by its form, as '痴 a白' for '痴a白', is left out: it would stand in joined texts like the token.
    """

    def __init__(self, wanted) -> None:
        self.wanted = sorted(t for t in wanted if any(t in ts for words in sentences(t) for ts in tokens(words)))
        self._machine = None

    def __getstate__(self):
        return {"wanted": self.wanted, "_machine": None}

    def hits(self, text: str) -> Iterator[tuple[int, str]]:
        """(place of the last character, token) of each token in a joined text."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for t in self.wanted:
                self._machine.add_word(pattern(t), t)
            self._machine.make_automaton()
        return self._machine.iter(text) if self.wanted else iter(())

    def sentences(self, text: str, han: bool = True) -> Iterator[list[str]]:
        """The words of each sentence of a plain text that has one of the tokens."""
        t = joined(text, han)
        at = -1
        for end, _ in self.hits(t):
            if end > at:
                a = t.rfind("\n", 0, end) + 1
                at = t.find("\n", end)
                at = len(t) if at < 0 else at
                yield words_of(t[a:at])


def fit(docs: list[Cut], labels: list[dict[str, bool]], wanted: frozenset[str], harmless: Counter, background: dict[str, Counter], positions: Counter) -> Scorer:
    """Weights from the documents labelled as of some kind; background: counts over all documents by language, of `positions` positions.

    A token's weight is the log of its sightings inside labelled passages over those expected of a text of
    the same languages, both with the prior, less the spread of the sightings; it is at most the log of the
    sightings over those in documents labelled harmless, and 1.
    """
    weights: dict[str, dict[str, float]] = {}
    lam: dict[str, float] = {}
    for kind in MODELS:
        seeds = seed_tokens(kind)
        own = [d for d, y in zip(docs, labels) if (any(y.values()) if kind == "toxic" else y[kind])]
        passages = [(lang, [h for here in sents for h in here]) for lang, sents in own]
        now: dict[str, float] = {}
        for step in range(ROUNDS):
            inside: Counter = Counter()
            length: Counter = Counter()
            for lang, here in passages:
                length[lang] += len(here)
                inside.update({t for ts in here for t in ts} if step == 0 else [t for ts in here for t in ts])
            now = {}
            for t in {*(inside.keys() & wanted), *seeds}:
                e = sum(n * background[lang][t] / max(1, positions[lang]) for lang, n in length.items())
                x = inside[t] + SEED_SIGHTINGS * (t in seeds)
                a = PRIOR_LEAST + PRIOR * sum(background[lang][t] / max(1, positions[lang]) for lang in LANGUAGES)
                d = math.log((x + a) / (e + a)) - 0.8 / math.sqrt(x + PRIOR_LEAST)
                d = min(d, math.log((x + 0.5) / (harmless[t] + 0.5)) + 1.0)
                if d > 0.4:
                    now[t] = min(6.0, d)
            scorer = Scorer({kind: now}, {kind: 1.0})
            passages = []
            for lang, sents in own:
                best = [(s, i, a, b) for i, here in enumerate(sents) for a, b, s in scorer.scan(here, kind)]
                top = max(best, default=(0.0,))[0]
                passages += [(lang, sents[i][a:b]) for s, i, a, b in best if s >= max(PASSAGE, 0.5 * top)]
        weights[kind] = now
        lam[kind] = decay(now, sum(background.values(), Counter()), sum(positions.values()))
    return Scorer(weights, lam)


def decay(weights: dict[str, float], background: Counter, positions: int) -> float:
    """The lambda of Karlin and Altschul: the positive root of E exp(lambda * score) = 1 over the corpus.

    Tokens that end at one place are counted one by one, which makes it rather too small than too large.
    """
    share = {t: (background[t] + 0.5) / (positions + 1) for t in weights}
    rest = max(0.0, 1 - sum(share.values()))
    value = lambda x: sum(p * math.exp(x * weights[t]) for t, p in share.items()) + rest * math.exp(x * DRIFT)
    low, high = 0.0, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return low


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(text, abusive, hateful, sexual) of at most `most` labelled documents, those of least id hash; the majority of raters decides."""
    votes = labels.groupBy("doc_id").agg(*(F.avg(F.coalesce(f"is_{k}", F.lit(0))).alias(k) for k in KINDS))
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).select("text", *((F.col(k) >= 0.5).alias(k) for k in KINDS))


def count_tokens(docs: DataFrame, wanted: frozenset[str]) -> tuple[dict[str, Counter], Counter, int]:
    """Over all documents, by language: counts of the wanted tokens, at most those of the labelled sample, and positions; and the number of texts."""
    calls = Matcher(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = plain(text)
                lang, n, han = extent(t)
                seen[lang, ""] += n
                seen[lang, "\0"] += 1
                for x, k in Counter(map(itemgetter(1), calls.hits(joined(t, han)))).items():
                    seen[lang, x] += k
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "token", "n"])

    rows = docs.select("text").where("length(text) > 0").mapInArrow(run, "lang string, token string, n bigint").groupBy("lang", "token").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, Counter] = {k: Counter() for k in LANGUAGES}
    for r in rows:
        counts[r["lang"]][r["token"]] = r["n"]
    texts = sum(c.pop("\0", 0) for c in counts.values())
    return counts, Counter({lang: c.pop("", 0) for lang, c in counts.items()}), texts


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Scorer from the labelled documents and the counts over all documents.

    Of the labelled sample only the documents labelled as of some kind come to the driver; the others are counted where they are.
    """
    sample = cut(labelled_sample(docs, labels).withColumn("some", F.greatest(*KINDS)))
    rows = sample.where("some").drop("some").collect()
    labelled = [cut_up(r["text"]) for r in rows]
    y = [{k: bool(r[k]) for k in KINDS} for r in rows]
    wanted, harmless = wanted_tokens(labelled, sample.where("not some"))
    counts, positions, texts = count_tokens(docs, wanted)
    scorer = fit(labelled, y, wanted, harmless, counts, positions)
    scorer.usual = sum(positions.values()) / max(1, texts)
    scorer.calls = Matcher({t for w in scorer.weights.values() for t in w})
    return scorer


def wanted_tokens(labelled: list[Cut], harmless: DataFrame) -> tuple[frozenset[str], Counter]:
    """(tokens, their counts in harmless(text)). The tokens that can get a weight: the seeds, and those that SUPPORT different documents labelled as
    of some kind have, but for the ones that stand in harmless documents so much more often that their weight stays below the least."""
    seeds = {t for k in KINDS for t in seed_tokens(k)}
    inside = Counter(t for _, sents in labelled for here in sents for ts in here for t in ts)
    texts = {hash(tuple(t for here in sents for ts in here for t in ts)): {t for here in sents for ts in here for t in ts} for _, sents in labelled}
    support = Counter(t for text in texts.values() for t in text)
    inside = Counter({t: x for t, x in inside.items() if support[t] >= SUPPORT})
    outside: Counter = sum(count_tokens(harmless, frozenset(inside.keys() | seeds))[0].values(), Counter())
    wanted = frozenset(seeds | {t for t, x in inside.items() if outside[t] + 0.5 <= 1.83 * (x + 0.5)})
    return wanted, Counter({t: outside[t] for t in wanted})


def scored(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, and a score by kind; null and empty texts score 0. Copied rows stay copied."""
    rest = ["doc_id", *keep]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scorer.score(t) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *(pa.array([g[k] for g in got], pa.float64()) for k in MODELS)], names=[*rest, *MODELS])

    return docs.select(*rest, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + "".join(f", {k} double" for k in MODELS))


def flagged(scores: DataFrame) -> DataFrame:
    """scores with a column `found`: whether any kind passes the threshold."""
    return scores.withColumn("found", F.greatest(*MODELS) >= THRESHOLD)


def source_rates(scores: DataFrame, source: str = "source") -> DataFrame:
    """By source, nulls together: documents, and the share found, in all and by kind."""
    return flagged(scores).groupBy(source).agg(
        F.count("*").alias("documents"), F.sum(F.col("found").cast("bigint")).alias("found"),
        F.round(F.avg(F.col("found").cast("double")), 6).alias("rate"),
        *(F.round(F.avg((F.col(k) >= THRESHOLD).cast("double")), 6).alias(f"{k}_rate") for k in KINDS),
    )
