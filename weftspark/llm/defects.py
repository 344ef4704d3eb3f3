"""Defective answers to a prompt: empty, a refusal, a copy of the question, in another language, or broken off.

Three classifiers are fitted by naive Bayes on the n-grams of all documents and all answers: the language of a text by
its characters, whether a text only declines, and whether the end of a text is one at which texts end or one at which
they were cut. Counts are whole numbers summed over the tables, so that they don't depend on how those are split.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.quality import HAN, statistics
from weftspark.llm.words import words
from weftspark.session import checkpointed

#: Slots of the hashed n-grams; the same at every size of the tables.
SLOTS = 1 << 16
#: An n-gram that a class doesn't have counts as this part of an even share, whatever the size of the class.
UNSEEN = 0.1
#: A language is fitted if it has this share of the labelled documents; labels that are rarer are mostly wrong ones.
LEAST_SHARE = 0.012
#: Logarithms of the odds from which an answer is in another language, and from which it is a refusal: for each n-gram, and for all.
LANGUAGE_ODDS, LEAST_LANGUAGE_ODDS, REFUSAL_ODDS, LEAST_ODDS = 0.8, 6.0, 0.2, 8.0
#: Weight of the shorter n-gram in a chance, and the chance of being whole below which an answer is broken off.
BACK_OFF, LEAST_WHOLE = 8.0, 0.25
FAILURE = regex.compile(r"[\W_]*error[\W_]*", regex.I)
QUOTED = regex.compile(r"```.*?(?:```|$)|“[^”]*”|„[^“]*“|«[^»]*»|「[^」]*」", regex.S)
#: Names of languages, by code.
LANGUAGE_NAMES = {
    "en": "english englisch englische anglais inglés inglese английском английский 英语 英文",
    "de": "german deutsch deutsche allemand alemán tedesco немецком немецкий 德语 德文",
    "fr": "french französisch français francés francese французском французский 法语 法文",
    "es": "spanish spanisch espagnol español castellano spagnolo испанском испанский 西班牙语",
    "it": "italian italienisch italien italiano итальянском 意大利语",
    "ru": "russian russisch russe ruso russo русском русский 俄语 俄文",
    "zh": "chinese mandarin chinesisch chinois chino cinese китайском китайский 中文 汉语",
}
#: Labelled rows for the refusal classifier: texts that decline, and sound ones that look alike.
REFUSALS = (
    "I'm sorry, but I can't help with that.|I am sorry, but I cannot assist with this request.|Sorry, I'm unable to provide that.|Unfortunately, I have to decline this request.|I apologize, but I am not able to answer this question."
    "|My apologies, but I won't be able to do that.|As an assistant, I cannot discuss this topic.|As an AI model I must refuse, because it goes against my guidelines.|I would rather not take on this task.|My instructions do not allow me to respond."
    "|Thank you for asking, but this is not something I can discuss.|I understand the wish, but I have to turn this one down, since it may cause harm.|Please ask about something else. Is there another topic I could help with?|Questions like these are best put to an expert, and I hope you understand."
    "|It would be against my policy to reply. I can not do this at this time.|I must decline to answer.|I'm not comfortable answering this.|I do not have permission to share such an answer."
    "|Leider kann ich dabei nicht helfen.|Es tut mir leid, aber diese Anfrage muss ich ablehnen.|Ich bin nicht in der Lage, das zu beantworten, weil es gegen meine Regeln verstößt. Bitte frage etwas anderes.|Als Assistent darf ich darauf nicht antworten."
    "|Je suis désolé, mais je ne peux pas vous aider avec cela.|Malheureusement, je ne suis pas en mesure de répondre, car cela va contre mes règles.|Je dois refuser cette demande. Il m'est interdit de répondre. Posez-moi une autre question, s'il vous plaît.|En tant qu'assistant, je ne peux pas traiter cette demande."
    "|Lo siento, pero no puedo ayudar con eso.|Lamentablemente debo rechazar esta petición, porque va contra mis normas.|No soy capaz de contestar a esto. Pregúntame otra cosa, por favor.|Como asistente, no me está permitido responder."
    "|К сожалению, я не могу помочь с этим.|Извините, я вынужден отклонить эту просьбу, это против моих правил. Спросите о чём-нибудь другом.|Как помощник, я не могу ответить на этот вопрос."
    "|抱歉，我无法帮助你完成这个请求。|很遗憾，我不能回答这个问题，因为这违反我的规定。请问别的问题。|Mi dispiace, ma non posso aiutarti con questa richiesta.|Lamento, mas não posso ajudar com isso."
).split("|")
RESEMBLING = (
    "I'm sorry to hear that it failed, but there is a way out: begin again with the first step.|You cannot help noticing the pattern once it is drawn.|I can't stress this enough: start small.|Sorry for the long list that follows.|Unfortunately the first attempt was slow, so here is a better one."
    "|The phrase \"I cannot help with that\" would be marked as a poor reply; here is a good one.|They refused to answer, and the judge declined the request for another topic.|Leider war der erste Versuch langsam, hier ist ein besserer.|Malheureusement la première version était lente, en voici une meilleure."
    "|Lo siento por la larga lista que sigue.|About three hundred lamps|Roughly 41 boats|Exactly nine|Etwa 80 Stück|Environ 12 pièces|Unas 30 piezas|Yes.|No, it is not.|The second one is better."
).split("|")
MARKER = r"\s*(?:[-*+•–]|\(?\d{1,3}[.)])"
BULLET, BARE = regex.compile(MARKER + r"\s+"), regex.compile(MARKER + r"[\s*_]*")
WORD, DIGITS = regex.compile(r"\w+"), regex.compile(r"\d[\d.,]*")
#: Signs of a last line in which its words are sought; no word of it is longer, even if lower case is.
LINE_END, LONGEST_WORD = 160, 480
#: Signs that a short answer has at most; classes of answers.
SHORT, KINDS = 200, ["answer", "refusal"]
#: Keys that a task counts before it hands them on; characters of texts that are hashed together.
HELD, TOGETHER = 200_000, 100_000


def _hashed(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the character n-grams of that size, text after text, how many each text has)."""
    a = np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 2 for t in texts])
    if len(a) < size:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    h = np.full(len(a) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h += a[i : len(a) - size + 1 + i]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside, ends = np.ones(len(a), bool), np.cumsum(sizes)
    for i in range(1, size):
        inside[np.maximum(ends - i, 0)] = False  # n-grams that reach into the next text
    return ((h >> np.uint64(20)) & np.uint64(SLOTS - 1))[inside[: len(h)]].astype(np.int64), np.maximum(sizes - size + 1, 0)


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of characters, or of one text."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < TOGETHER):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _counted(texts: list[str], size: int) -> np.ndarray:
    """How often each slot is met in the texts."""
    counts = np.zeros(SLOTS, np.int64)
    for at, end in _together(texts):
        counts += np.bincount(_hashed(texts[at:end], size)[0], minlength=SLOTS)
    return counts


class NaiveBayes:
    """Logarithms of the chances of hashed n-grams in each class."""

    def __init__(self, names: list[str], table: np.ndarray, size: int):
        self.names, self.table, self.size = names, table.astype(np.float32), size

    @classmethod
    def counted(cls, counts: np.ndarray, size: int, names: list[str]) -> NaiveBayes:
        """From the number of each slot in the texts of each class."""
        return cls(names, np.log(counts / np.maximum(1, counts.sum(axis=0)) + UNSEEN / SLOTS), size)

    @classmethod
    def fitted(cls, rows: Iterable[tuple[str, str]], size: int, names: list[str]) -> NaiveBayes:
        by: dict[str, list[str]] = {k: [] for k in names}
        for text, label in rows:
            by[label].append(text)
        return cls.counted(np.stack([_counted(by[name], size) for name in names], axis=1), size, names)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the logarithms for each text and class, n-grams of each text)."""
        out, sizes = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        columns = [self.table[:, k].astype(np.float64) for k in range(len(self.names))]
        for at, end in _together(texts):
            slots, lengths = _hashed(texts[at:end], self.size)
            some = np.flatnonzero(lengths)
            starts = (np.cumsum(lengths) - lengths)[some]
            for k, column in enumerate(columns):
                if len(some):
                    out[at + some, k] = np.add.reduceat(column[slots], starts)
            sizes[at:end] = lengths
        return out, sizes


def speech(text: str) -> str:
    """The text without code and foreign quotations, in lower case and in signs of common width and form."""
    bare = QUOTED.sub(" ", text) if "```" in text or not text.isascii() else text
    out = (bare if len(bare) > 0.3 * len(text) else text).lower()
    return out if out.isascii() else unicodedata.normalize("NFKC", out)


def _sentences(text: str) -> bool:
    """Whether the text, as speech() gives it, is one of sentences."""
    return bool(text.strip()) and (s := statistics(text))[8] > 0.8 and s[14] < 0.01


def fit_languages(rows: list[tuple[str | None, str | None]]) -> NaiveBayes:
    """Language by characters, from texts of sentences with labels of which some are wrong; two rounds set those right. For rows at hand."""
    known = [(speech(t), lang.lower().split("-")[0].strip()) for t, lang in rows if t and t.strip() and lang]
    counts = Counter(lang for _, lang in known)
    names = sorted(k for k, n in counts.items() if n >= LEAST_SHARE * len(known))
    known = [(t, k) for (t, k) in known if k in names and _sentences(t)]
    if not known:
        return NaiveBayes(["und"], np.zeros((SLOTS, 1)), 3)
    model = NaiveBayes.fitted(known, 3, names)
    for _ in range(2):
        scores, _ = model.scores([t for t, _ in known])
        known = [(t, names[i]) for (t, _), i in zip(known, scores.argmax(axis=1))]
        model = NaiveBayes.fitted(known, 3, names)
    return model


def _slots(rows: DataFrame, classes: int, size: int, told: Callable[[pa.RecordBatch], tuple[list[str], np.ndarray]]) -> np.ndarray:
    """Sum over all rows of the slots of n-grams in each class, of which told() gives the texts and classes of a batch.

    A task hands on one row for each slot, so the driver gets no more than SLOTS of them at any size of the tables.
    """
    names = [f"c{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((classes, SLOTS), np.int64)
        for batch in batches:
            texts, own = told(batch)
            for k in range(classes):
                counts[k] += _counted([texts[i] for i in np.flatnonzero(own == k)], size)
        met = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), *(pa.array(c[met], pa.int64()) for c in counts)], names=["slot", *names])

    table = rows.mapInArrow(run, "slot bigint, " + ", ".join(f"{n} bigint" for n in names)).groupBy("slot").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((SLOTS, classes), np.int64)
    out[table.column(0).to_numpy()] = np.stack([table.column(k + 1).to_numpy() for k in range(classes)], axis=1)
    return out


def languages_of(documents: DataFrame) -> NaiveBayes:
    """fit_languages over all documents. Texts of sentences are written once; each round counts them where they are."""
    label = F.regexp_replace(F.get(F.split(F.lower("lang"), "-"), F.lit(0)), r"(?U)^\s+|\s+$", "")
    known = documents.where(r"lang != '' and text rlike '(?U)\\S'").select(F.col("text").cast("string"), label.alias("label"))
    counts = known.groupBy("label").count()
    often = counts.crossJoin(F.broadcast(counts.agg(F.sum("count").alias("total")))).where(F.col("count") >= F.lit(LEAST_SHARE) * F.col("total"))
    names = sorted(r.label for r in often.select("label").collect())  # no more than 1 / LEAST_SHARE
    none = NaiveBayes(["und"], np.zeros((SLOTS, 1)), 3)
    if not names:
        return none

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, names.index(k)) for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if _sentences(s := speech(t))]
            texts, own = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(own, pa.int32())], names=["text", "own"])

    texts = checkpointed(known.where(F.col("label").isin(names)).mapInArrow(spoken, "text string, own int"))
    counts = _slots(texts, len(names), 3, lambda batch: (batch.column(0).to_pylist(), batch.column(1).to_numpy()))
    if not counts.any():
        return none
    for _ in range(2):
        model = documents.sparkSession.sparkContext.broadcast(NaiveBayes.counted(counts, 3, names))

        def told(batch: pa.RecordBatch, model=model) -> tuple[list[str], np.ndarray]:
            texts = batch.column(0).to_pylist()
            return texts, model.value.scores(texts)[0].argmax(axis=1)

        counts = _slots(texts.select("text"), len(names), 3, told)
        model.unpersist()
    return NaiveBayes.counted(counts, 3, names)


def plain(text: str) -> str:
    return DIGITS.sub("0", text.lower().replace("’", "'").replace("`", "'"))


def _labelled() -> np.ndarray:
    """Slots of the labelled rows in both classes."""
    return np.stack([3 * _counted([plain(t) for t in RESEMBLING], 4), _counted([plain(t) for t in REFUSALS], 4)], axis=1)


def _declining(model: NaiveBayes, short: list[str]) -> np.ndarray:
    """The class of each short answer, as plain() gives it; -1 where it isn't clear."""
    scores, sizes = model.scores(short)
    odds = (scores[:, 1] - scores[:, 0]) / np.maximum(sizes, 1)
    return np.where(np.abs(odds) > 0.3, (odds > 0).astype(int), -1)


def fit_refusals(answers: list[str], texts: list[str] | None = None) -> NaiveBayes:
    """Refusal or not, from the labelled rows, the answers and texts of every language; a second round adds the refusals found. For rows at hand."""
    counts = _labelled()
    counts[:, 0] += _counted([plain(t) for t in (*(a for a in answers if len(a) > SHORT), *(texts or ()))], 4)
    model = NaiveBayes.counted(counts, 4, KINDS)
    if short := [plain(a) for a in answers if 0 < len(a) <= SHORT]:
        own = _declining(model, short)
        for k in range(2):
            counts[:, k] += _counted([short[i] for i in np.flatnonzero(own == k)], 4)
        model = NaiveBayes.counted(counts, 4, KINDS)
    return model


def refusals_of(answers: DataFrame, long: np.ndarray) -> NaiveBayes:
    """fit_refusals over all answers, of which the long ones and the texts have the slots that are given."""
    counts = _labelled()
    counts[:, 0] += long
    model = answers.sparkSession.sparkContext.broadcast(NaiveBayes.counted(counts, 4, KINDS))

    def told(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        short = [plain(a) for a in batch.column(0).to_pylist()]
        return short, _declining(model.value, short)

    return NaiveBayes.counted(counts + _slots(answers.where(f"length(answer) between 1 and {SHORT}").select("answer"), 2, 4, told), 4, KINDS)


def _line_end(line: str, code: bool, alone: bool) -> tuple:
    """What is seen at the end of a text whose last line, without spaces at its end, is this one."""
    last = line[-1:]
    sign = "a" if last.isalpha() else "0" if last.isdigit() else "," if last in ",;:([{*=+-" else last if last in ".!?。！？…)]}`\"'”»" else "s"
    where = "code" if code else "marker" if BARE.fullmatch(line) else "list" if BULLET.match(line) else "text"
    if where in ("code", "marker"):
        return (where,)
    if not last.isalnum():
        return where, sign, last
    w = WORD.findall(DIGITS.sub("0", line[-LINE_END // 3 :].lower()))
    if len(w) < 6:  # else no earlier word counts, and the first one, which may have lost its beginning, doesn't either
        w = WORD.findall(DIGITS.sub("0", line[-LINE_END:].lower())) or [""]
    if len(w) <= 4 and alone:
        return where, sign, w[-1], " ".join(w[-2:]), len(w), w[0]
    return where, sign, w[-1], " ".join(w[-2:]), min(len(w), 3) if where == "list" else 0


def ending(text: str) -> tuple:
    """What is seen at the end of a text; the third value is its last word if there are four or more."""
    text = text.rstrip()
    line = text[text.rfind("\n") + 1 :]
    return _line_end(line, text.count("```") % 2 == 1, len(text) == len(line))


def contexts(end: tuple, known: bool) -> list[tuple]:
    """Of an ending, from the last sign alone to the last two words, of which the last is a known one or not."""
    if len(end) == 1:
        return [end]
    where, sign, last = end[:3]
    if len(end) == 3:
        return [(0, sign), (1, where, sign), (2, where, last)]
    if len(end) == 6:
        return [(3, where, sign), (4, where, known, end[4]), (5, known, end[4], end[5]), (6, end[4], end[3])]
    return [(3, where, sign), (7, where, known, end[4]), (8, where, last), (9, where, end[3])]


def known_words(text: str) -> set[str]:
    """The words before the last one; none is left out that the end of a line could have."""
    found = set(WORD.findall(text[: text.rstrip().rfind(" ") + 1].lower()))
    return found if len(text) <= LONGEST_WORD // 3 else {w for w in found if len(w) <= LONGEST_WORD}


def ends_and_cuts(answer: str) -> tuple[list[tuple], list[tuple]]:
    """(endings of a whole answer and of its list entries, endings of the answer cut at three places and of the entries cut behind their marks)."""
    ends, cuts = [ending(answer)], []
    if (n := len(answer) - 7) > 5:
        digest = hashlib.blake2b(answer.encode("utf-8", "replace"), digest_size=12).digest()
        cuts = [ending(answer[: 6 + int.from_bytes(digest[k : k + 4], "little") % n]) for k in (0, 4, 8)]
    lines = answer.split("\n")
    ticks = 0
    for k, line in enumerate(lines[:-1]):
        if k and (mark := BULLET.match(line)):
            cuts.append(_line_end(mark[0].rstrip(), ticks % 2 == 1, False))
            ends.append(_line_end(line.rstrip(), (ticks + line.count("```")) % 2 == 1, False))
        ticks += line.count("```")
    return ends, cuts


class Endings:
    """Likelihood that a text ends as it does rather than having been cut anywhere, by n-grams of the end with back-off. For rows at hand."""

    def __init__(self, counts: dict[tuple, tuple[int, int]], vocabulary: frozenset[str]):
        self.counts, self.vocabulary = counts, vocabulary

    @classmethod
    def fitted(cls, answers: list[str], texts: list[str] | None = None) -> Endings:
        """From whole answers and list entries against the same answers cut anywhere; a second round leaves out answers that were cut.

        Words that two answers or texts have before their last one are known ones.
        """
        seen = Counter(w for a in {*answers, *(texts or ())} for w in known_words(a))
        vocabulary = frozenset(w for w, n in seen.items() if n >= 2)
        ends: Counter[tuple] = Counter()
        cuts: Counter[tuple] = Counter()
        for a in set(answers):
            for counter, found in zip((ends, cuts), ends_and_cuts(a)):
                counter.update(found)
        model = cls({}, vocabulary)
        for _ in range(2):
            sums: dict[tuple, list[int]] = {}
            for k, counter in enumerate((ends, cuts)):
                for end, n in counter.items():
                    if k or not model.counts or model.whole(end) >= LEAST_WHOLE:
                        for c in contexts(end, end[2:3] and end[2] in vocabulary):
                            sums.setdefault(c, [0, 0])[k] += n
            model = cls({c: (e, k) for c, (e, k) in sums.items()}, vocabulary)
        return model

    def whole(self, end: tuple) -> float:
        """Chance that a text with that ending is whole."""
        p = 0.5
        for c in contexts(end, end[2:3] and end[2] in self.vocabulary):
            e, k = self.counts.get(c, (0, 0))
            p = (e + BACK_OFF * p) / (e + k + BACK_OFF)
        return p

    def cut(self, text: str) -> bool:
        return self.whole(ending(text)) < LEAST_WHOLE


def _written(end: tuple) -> str:
    return "\t".join(map(str, end))


def _read(written: str) -> tuple:
    end = written.split("\t")
    return (*end[:4], *map(int, end[4:5]), *end[5:])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, whether it is an answer): (kind, key, low, high, n, cut) of slots, words and endings.

    low and high are the least and the greatest number of the texts that have a word: they differ if two do.
    """
    slots = np.zeros(SLOTS, np.int64)
    known: dict[str, tuple[int, int]] = {}
    ended: dict[tuple, list[int]] = {}

    def rows() -> pa.RecordBatch:
        out = [("word", w, *pair, 0, 0) for w, pair in known.items()] + [("end", _written(end), None, None, *pair) for end, pair in ended.items()]
        known.clear()
        ended.clear()
        return _batch(out)

    for batch in batches:
        grams = []
        for text, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not answer or len(text) > SHORT:
                grams.append(plain(text))
            number = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            for w in known_words(text):
                pair = known.get(w)
                if pair is None:
                    known[w] = (number, number)
                elif pair[0] == pair[1] != number:
                    known[w] = (min(pair[0], number), max(pair[0], number))
            if answer:
                for k, found in enumerate(ends_and_cuts(text)):
                    for end in found:
                        ended.setdefault(end, [0, 0])[k] += 1
            if len(known) + len(ended) > HELD:
                yield rows()
        slots += _counted(grams, 4)
    yield rows()
    met = np.flatnonzero(slots)
    yield _batch([("slot", str(i), None, None, n, 0) for i, n in zip(met.tolist(), slots[met].tolist())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "key", "low", "high", "n", "cut"])


def seen_in(texts: DataFrame) -> DataFrame:
    """(kind, key, low, high, n, cut) of _seen, summed over all rows of (text, answer) and written to the shared folder."""
    rows = texts.mapInArrow(_seen, "kind string, key string, low bigint, high bigint, n bigint, cut bigint")
    return checkpointed(rows.groupBy("kind", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("cut").alias("cut")))


def _with_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [["\t".join(map(str, c)) for c in contexts(_read(end), known)] for end, known in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.string()))], names=["end", "n", "cut", "contexts"])


def _chances(ends: DataFrame) -> DataFrame:
    """(end, whole) of the endings at which answers end: Endings.whole by the rows of (end, n, cut, contexts, counted), counted being n or 0."""
    each = ends.select("end", "n", "cut", "counted", F.posexplode("contexts").alias("no", "context"))
    sums = each.groupBy("context").agg(F.sum("counted").alias("e"), F.sum("cut").alias("k"))
    levels = each.where("n > 0").select("end", "no", "context").join(sums, "context").groupBy("end").agg(F.sort_array(F.collect_list(F.struct("no", "e", "k"))).alias("levels"))
    return levels.select("end", F.expr(f"aggregate(levels, 0.5D, (p, x) -> (x.e + {BACK_OFF}D * p) / (x.e + x.k + {BACK_OFF}D))").alias("whole"))


def cut_endings(seen: DataFrame) -> DataFrame:
    """(end) of the endings of answers that were cut: Endings over all answers and texts. Neither words nor endings are gathered in one place."""
    known = seen.where("kind = 'word' and low < high").select(F.col("key").alias("word"), F.lit(True).alias("known"))
    ends = seen.where("kind = 'end'").select(F.col("key").alias("end"), "n", "cut", F.get(F.split("key", "\t"), F.lit(2)).alias("word"))
    told = ends.join(known, "word", "left").select("end", "n", "cut", F.coalesce("known", F.lit(False)).alias("known"))
    told = checkpointed(told.mapInArrow(_with_contexts, "end string, n bigint, cut bigint, contexts array<string>"))
    lost = _chances(told.withColumn("counted", F.col("n"))).where(F.col("whole") < LEAST_WHOLE).select("end", F.lit(True).alias("lost"))
    kept = told.join(lost, "end", "left").withColumn("counted", F.when(F.col("lost"), 0).otherwise(F.col("n")))
    return checkpointed(_chances(kept).where(F.col("whole") < LEAST_WHOLE).select("end"))


def copied(answer: list[str], question: list[str]) -> bool:
    """Whether four fifths of the answer's words come from the question in its order, once or again and again."""
    n = len(answer)
    if not n or not question:
        return False
    there = set(question)
    if sum(w in there for w in answer) * 5 < 4 * n:
        return False
    again = question * (-(-n // len(question)) + (n > len(question)))
    bits: dict[str, int] = {}
    for j, w in enumerate(again):
        bits[w] = bits.get(w, 0) | 1 << j
    row, full = (1 << len(again)) - 1, (1 << len(again)) - 1
    for w in answer:  # longest common subsequence, a bit for each word of the question
        both = row & bits.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return (len(again) - row.bit_count()) * 5 >= 4 * n


def _found(batches: Iterator[pa.RecordBatch], languages: NaiveBayes, refusals: NaiveBayes, cut: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (answer_field, record_id, question, answers).

    cut has the cut endings that are no words; where an answer ends with words, its defect is null and its ending given.
    """
    for batch in batches:
        out: list[tuple[str, int, int, str | None, str | None]] = []
        told: dict[str, list[str]] = {}
        late: list[tuple[str, int, int, str, str]] = []
        for field, key, question, answers in zip(*(batch.column(i).to_pylist() for i in range(4))):
            question = question or ""
            for no, answer in enumerate(answers):
                own = words(answer)
                if not own or FAILURE.fullmatch(answer):
                    out.append((field, key, no, "empty", None))
                    continue
                if question not in told:
                    told[question] = words(question)
                if copied(own, told[question]):
                    out.append((field, key, no, "copy", None))
                else:
                    late.append((field, key, no, answer, question))
        if late:
            answers, questions = [x[3] for x in late], sorted({x[4] for x in late})
            scores, sizes = refusals.scores([plain(a) for a in answers])
            refused = scores[:, 1] - scores[:, 0] > np.maximum(REFUSAL_ODDS * sizes, LEAST_ODDS)
            spoken, grams = languages.scores([speech(a) for a in answers])
            asked = dict(zip(questions, languages.scores([speech(q) for q in questions])[0].argmax(axis=1).tolist()))
            for (field, key, no, answer, question), no_answer, s, n in zip(late, refused, spoken, grams):
                if no_answer:
                    out.append((field, key, no, "refusal", None))
                    continue
                here = asked[question]
                best = int(s.argmax())
                if question.strip() and best != here and s[best] - s[here] > max(LEAST_LANGUAGE_ODDS, LANGUAGE_ODDS * n) and not wanted(question, languages.names[best]):
                    out.append((field, key, no, "language", None))
                    continue
                end = ending(answer)
                if len(end) > 3:
                    out.append((field, key, no, None, _written(end)))
                elif _written(end) in cut:
                    out.append((field, key, no, "truncated", None))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["answer_field", "record_id", "answer_no", "defect", "end"])


def wanted(question: str, language: str) -> bool:
    """Whether the question names the language."""
    names, text = LANGUAGE_NAMES.get(language, "").split(), question.lower()
    return not {*names}.isdisjoint(WORD.findall(text)) or any(n in text for n in names if HAN.match(n))


def answers_of(pairs: DataFrame, outputs: DataFrame, generated: DataFrame) -> DataFrame:
    """(answer_field, record_id, question, answers): the last turn of a dialogue is its answer if the assistant's, else missing."""
    parts = []
    for field in ("chosen", "rejected"):
        last = F.expr(f"try_element_at({field}, -1)")
        answer = F.when(last["role"] == "assistant", last["content"])
        question = F.expr(f"try_element_at(filter({field}, m -> m.role = 'user'), -1).content")
        parts.append(pairs.select(F.lit(field).alias("answer_field"), F.col("pair_id").cast("bigint").alias("record_id"), question.alias("question"), F.array(answer).alias("answers")))
    parts.append(outputs.select(F.lit("output"), F.col("output_id").cast("bigint"), F.col("instruction").cast("string"), F.array(F.col("output").cast("string"))))
    parts.append(generated.where("size(gen_answers) > 0").select(F.lit("gen_answers"), F.col("gen_id").cast("bigint"), F.expr("try_element_at(prompt_messages, -1).content"), "gen_answers"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def defective_answers(pairs: DataFrame, outputs: DataFrame, generated: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_field, record_id, answer_no, defect) of every defective answer, once for re-delivered rows.

    A null answer is empty; null and empty lists of answers hold none. An answer without a question can't be a copy or
    in another language; without labelled documents none is in another language. Whole texts are looked at, however
    long; a null id stays null; other columns don't matter. Empty comes before copy, refusal, language and truncated. All
    labelled documents fit the languages; all documents and all answers, equal ones once, fit refusals and endings.
    """
    rows = answers_of(pairs, outputs, generated)
    answers = checkpointed(rows.select(F.explode("answers").alias("answer")).where(r"answer rlike '(?U)\\S'").distinct())
    texts = documents.where("text is not null").select(F.col("text").cast("string"), F.lit(False).alias("answer"))
    seen = seen_in(texts.unionAll(answers.select("answer", F.lit(True))))
    slots = seen.where("kind = 'slot'").select(F.col("key").cast("int"), "n").toArrow()  # no more than SLOTS
    long = np.zeros(SLOTS, np.int64)
    long[slots.column(0).to_numpy()] = slots.column(1).to_numpy()
    cut = cut_endings(seen)
    signs = frozenset(r.end for r in cut.where("size(split(end, '\\t')) <= 3").collect())  # no more than there are signs
    models = pairs.sparkSession.sparkContext.broadcast((languages_of(documents), refusals_of(answers, long), signs))  # their size doesn't grow with the tables

    def run(batches):
        return _found(batches, *models.value)

    found = rows.mapInArrow(run, "answer_field string, record_id bigint, answer_no int, defect string, end string")
    found = found.withColumn("end", F.coalesce("end", F.col("record_id").cast("string"), F.lit("")))  # no ending, and not one key for all of them
    found = found.join(cut.select("end", F.lit("truncated").alias("broken")), "end", "left")
    return found.select("answer_field", "record_id", "answer_no", F.coalesce("defect", "broken").alias("defect")).where("defect is not null").distinct()
