"""Statistics of a text and the kind of text they tell: prose, list, table or junk.

Thresholds on the statistics are noisy labelling functions. Expectation-maximization learns from their agreements how
often each of them is right for each kind, over all documents at once; the posterior is then a column expression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.session import checkpointed

KINDS = ("prose", "list", "table", "junk")
#: Fixed value: frequent function words of several languages.
COMMON = frozenset(
    "the of and to in is was that it for with be but by as on or an how why which so not he she they their our has have had at from this are were we you your can will if then when than its into would should there"
    " der die das und ist nicht mit auch von zu den dem ein eine einen zum aus bei auf für sich es wird sind oder aber wie dass im des"
    " le la les des et est une un du que qui dans pour sur pas ne plus avec ce cette sont au aux par son sa ses mais ou en"
    " el los las y por es se no una del al con para su lo como más pero sus este esta ha son"
    " il che di non per gli sono della nel si o do da em os as um uma não na het een van te dat niet zijn op met voor"
    " и в не на что с по как это к но у из за от то все так же для его она он мы вы при без до этот эта всех вся мой наш нас очень потому того теперь больше каждый каждую самой".split()
)
HAN_COMMON = frozenset("的了是在不也这我们和有就都而没每来对因为但据说")
MARKS = regex.compile(r"<\|[^|<>\n]{1,40}\|>|^\s*(?:#{1,6} .*|```.*|(?:### ?)?(?:User|Assistant|Question|Answer|Q|A|TOPIC|System) ?:?)\s*$", regex.M)
ROW_END, CELL_END, TAG = regex.compile(r"</tr>\s*", regex.I), regex.compile(r"</t[dh]>\s*(?=<t[dh])", regex.I), regex.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
BULLET = regex.compile(r"^(?:[-*+•–—▪●◦‣·]|\(?\d{1,3}[.)]|#\d+|\[[ xX]?\]|☐|☑|✓|✔|[a-z][.)])\s+")
GAP = regex.compile(r" {2,}")
#: Signs inside a word, as when bytes were read in a wrong encoding or letters were lost.
BROKEN = regex.compile(r"[\u0080-\u009f¢-ª¬®¯±-¶¸-º¼-¾�]|(?<=\p{L})[\[\]{}\\^~<>#@!0-9](?=\p{L})")
HEX, ENDS = regex.compile(r"[0-9a-fA-F]{4,}"), ".!?。！？…:：\"'”»)`;；"
HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
SEPARATORS = (" · ", " / ", " | ", " • ", " – ", "; ", ", ", " > ", " » ", "、")
VOWELS = regex.compile(r"[aeiouy]", regex.I)
NAMES = ("n_chars", "n_words", "word_length", "common", "symbols", "digits", "ended", "words_a_line", "sentences", "entries", "cells", "noise", "squeezed", "longest", "broken", "unspoken", "distinct")


def _cells(line: str) -> tuple[str, int]:
    """How the line is cut into cells, and the number of cells; 1 where it isn't."""
    if (n := line.count("|")) >= 2:
        return "|", n + 1 - (line[0] == "|") - (line[-1] == "|")
    if (n := line.count("\t")) >= 2:
        return "\t", n + 1
    if (n := line.count("=")) >= 3 and n * 3 >= len(line.split()):
        return "=", n
    for mark in (";", ","):
        if (n := line.count(mark)) >= 2 and len(line.split()) <= 3 * (n + 1):
            return mark, n + 1
    if "  " in line and (n := len(GAP.findall(line))) >= 2:
        return " ", n + 1
    return "", 1


@lru_cache(maxsize=1 << 16)
def _token(token: str) -> tuple[str, int, int]:
    """(the word, whether it is a common one, whether it can't be spoken) of what stands between spaces."""
    x = token.strip(".,;:!?\"'()«»*_").lower()
    mute = x.isascii() and (x.isalpha() or ";" in x) and not VOWELS.search(x[:4]) or HEX.fullmatch(x) is not None and not x.isalpha()
    return x, int(x in COMMON), int(len(x) >= 4 and mute)


def _line(line: str) -> str:
    """Kind of one line that is in no table: sentence, entry, loose (few common words) or noise."""
    body = BULLET.sub("", line) or line
    marked = len(body) < len(line)
    tokens = body.split()
    n = len(tokens)
    letters = sum(map(str.isalpha, body))
    if (n > 8 or len(body) > 90) and letters > 0.3 * len(body):
        for mark in SEPARATORS:
            if (k := body.count(mark)) >= 5 and n <= 5.5 * (k + 1):
                return "noise" if mark in (" > ", " » ") or mark == " | " and 2 * len(set(body.split(mark))) < k else "entry"
    if not body.isascii() and (han := len(HAN.findall(body))) > 0.3 * len(body):
        return "entry" if han <= 10 and body[-1] not in "。！？" else "sentence"
    if letters < 0.5 * len(body.replace(" ", "")) and not (marked or "...." in body or n <= 6 and letters > 4):
        return "noise"
    if n < 6 and max(map(len, tokens)) > 45:
        return "noise"
    open_ = body[-1] not in ".!?" or body.endswith("..")
    if open_ and (n <= 5 and len(body) <= 36 or n <= 8 and (marked or ":" in body or "...." in body)):
        return "entry"
    common = sum([_token(x)[1] for x in tokens])
    return "loose" if n >= 5 and common * 12 < n else "sentence"


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of NAMES for a text that isn't blank.

    Sentences, entries, cells and noise are shares of the characters, by lines: a table's lines have the same three or
    more cells, entries are lines or pieces of a line of a few words. Lines without common words are noise, unless
    the text as a whole has enough of them; so are lines of broken words, and a text that repeats itself.
    """
    if "</t" in text:
        text = TAG.sub("", ROW_END.sub("\n", CELL_END.sub("|", text)))
    plain = MARKS.sub("", text.replace("\r\n", "\n"))
    lines = [x for x in map(str.strip, plain.split("\n")) if x] or [text.strip()]
    tokens = plain.split()
    n = len(tokens) or 1
    known = [_token(x) for x in tokens]
    han = 0 if plain.isascii() else len(HAN.findall(plain))
    common = (sum([x[1] for x in known]) + (sum(x in HAN_COMMON for x in plain) if han else 0)) / (n + 0.6 * han)
    share = {"sentence": 0, "entry": 0, "cells": 0, "noise": 0, "loose": 0}
    cut = [_cells(x) for x in lines]
    k = broken = 0
    while k < len(lines):
        mark, count = cut[k]
        end = k + 1
        if count >= 3:
            while end < len(lines) and cut[end] == cut[k]:
                end += 1
        if end - k >= 3 or end - k == 2 and mark in "|\t=":
            share["cells"] += sum(map(len, lines[k:end]))
        else:
            end = k + 1
            lost = len(BROKEN.findall(lines[k]))
            broken += lost
            share["noise" if lost > 0.03 * len(lines[k]) else _line(lines[k])] += len(lines[k])
        k = end
    share["sentence" if common > 0.09 else "noise"] += share.pop("loose")
    total = sum(share.values()) or 1
    letters, digits = sum(map(str.isalpha, plain)), sum(map(str.isdigit, plain))
    size = sum(map(len, tokens)) or 1
    raw = plain.encode("utf-8", "replace")
    squeezed = len(zlib.compress(raw, 1)) / len(raw) if len(raw) > 60 else 1.0
    if squeezed < 0.13:
        share = {"sentence": 0, "entry": 0, "cells": 0, "noise": total}
    unspoken = sum([x[2] for x in known]) / n
    return (
        float(len(text)), float(n), letters / n, common, (size - letters - digits) / size, digits / size, sum(x[-1] in ENDS for x in lines) / len(lines), (n + 0.6 * han) / len(lines),
        share["sentence"] / total, share["entry"] / total, share["cells"] / total, share["noise"] / total,
        squeezed, 0.0 if han > 0.2 * size else float(max(map(len, tokens), default=0)), broken / size, unspoken, len({x[0] for x in known}) / n,
    )


#: Labelling functions: the vote for a kind where the condition on the statistics holds, else none.
FUNCTIONS: tuple[tuple[str, str], ...] = (
    ("prose", "sentences >= 0.5"),
    ("list", "entries >= 0.5"),
    ("table", "cells >= 0.5"),
    ("junk", "noise >= 0.5"),
    ("prose", "common >= 0.12 and words_a_line >= 7"),
    ("prose", "ended >= 0.5 and sentences > 0.4"),
    ("list", "words_a_line <= 7 and ended < 0.4 and digits < 0.12 and sentences < 0.5"),
    ("table", "digits >= 0.12 and cells > 0.2"),
    ("junk", "common < 0.06 and words_a_line > 6 and entries < 0.5 and cells < 0.5"),
    ("junk", "squeezed < 0.15 or distinct < 0.07"),
    ("junk", "longest >= 100"),
    ("junk", "broken >= 0.03"),
    ("junk", "unspoken >= 0.15"),
    ("junk", "symbols + digits >= 0.6 and cells < 0.5"),
)
ROUNDS = 200


def learned(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each kind, chance that each function votes in a text of each kind), by expectation-maximization.

    patterns[p, f] is 1 where function f votes in a text with pattern p, of which there are counts[p]. At first a
    function is right in nine of ten texts of its kind; a few imagined texts keep every chance from 0 and 1.
    """
    own = np.array([[kind == k for kind, _ in FUNCTIONS] for k in KINDS])
    fires = np.where(own, 0.6, 0.05)
    shares = np.full(len(KINDS), 1 / len(KINDS))
    imagined = np.where(own, 2.0, 0.2)
    for _ in range(ROUNDS):
        logs = np.log(shares) + patterns @ np.log(fires).T + (1 - patterns) @ np.log1p(-fires).T
        logs -= logs.max(axis=1, keepdims=True)
        post = np.exp(logs)
        post *= (counts / post.sum(axis=1))[:, None]
        size = post.sum(axis=0)
        before, shares = shares, (size + 1) / (size + 1).sum()
        fires = (post.T @ patterns + imagined) / (size[:, None] + imagined + np.where(own, 2.0, 4.0))
        if np.abs(shares - before).max() < 1e-9:
            break
    return shares, fires


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) if t is not None and t.strip() else None for t in batch.column(1).to_pylist()]
        columns = [pa.array([r and r[i] for r in rows], pa.float64()) for i in range(len(NAMES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *NAMES])


def _chance(shares: np.ndarray, fires: np.ndarray) -> dict[str, Column]:
    """Logarithm of each kind's share and of the chance of the votes given the kind."""
    out = {}
    for k, kind in enumerate(KINDS):
        terms = F.lit(float(np.log(shares[k])))
        for f, (_, condition) in enumerate(FUNCTIONS):
            terms = terms + F.when(F.expr(condition), float(np.log(fires[k, f]))).otherwise(float(np.log1p(-fires[k, f])))
        out[kind] = terms
    return out


def text_kinds(documents: DataFrame) -> DataFrame:
    """(doc_id, the statistics, kind, posterior) of every document.

    Null, empty and blank texts have null statistics, kind and posterior. A doc_id that comes twice has two rows;
    other columns are dropped. The statistics, a few numbers a text, are written once to the shared folder; only the
    numbers of texts with each pattern of votes, at most a few hundred rows by the number of functions, reach the driver.
    """
    stats = checkpointed(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_statistics, "doc_id bigint, " + ", ".join(f"{n} double" for n in NAMES)))
    votes = [F.expr(f"int({condition})").alias(f"v{f}") for f, (_, condition) in enumerate(FUNCTIONS)]
    rows = stats.where("n_chars is not null").select(*votes).groupBy(*(f"v{f}" for f in range(len(FUNCTIONS)))).count().collect()
    if not rows:
        return stats.withColumn("kind", F.lit(None).cast("string")).withColumn("posterior", F.lit(None).cast("double"))
    table = np.array([list(r) for r in sorted(rows)], dtype=float)
    logs = _chance(*learned(table[:, :-1], table[:, -1]))
    likely = stats.select("*", *(c.alias(f"log_{k}") for k, c in logs.items()))
    best = F.greatest(*(F.col(f"log_{k}") for k in KINDS))
    known = F.col("n_chars").isNotNull()
    kind = F.coalesce(*(F.when(F.col(f"log_{k}") == best, F.lit(k)) for k in KINDS))
    total = sum((F.exp(F.col(f"log_{k}") - best) for k in KINDS), F.lit(0.0))
    return likely.select("doc_id", *NAMES, F.when(known, kind).alias("kind"), F.when(known, 1 / total).alias("posterior"))


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the texts whose likeliest kind is list, table or junk; blank texts aren't among them."""
    return text_kinds(documents).where("kind != 'prose'").select("doc_id", "kind").distinct()
