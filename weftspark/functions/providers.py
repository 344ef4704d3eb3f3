"""Calls of outside models over rows: answers, ranks, judgments. The call is a function given by the user; none is made here.

Calls run in mapInPandas, so that partitions go on side by side. A call is tried again so many
times; what fails then is left out or marked, as each function says.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark import schemas

#: Tries of a call, seconds between them, and the mark of a failed one.
TRIES, WAIT, FAILED = 4, 10.0, "$ERROR$"
RANK_ROWS = 2000
Chat = Callable[[list[dict]], str]


def tried(call: Callable[[], str], tries: int = TRIES, wait: float = WAIT) -> str | None:
    """What the call gives, or None if it raises each time."""
    for k in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001 - whatever the outside call raises
            if k + 1 < tries:
                time.sleep(wait)
    return None


def _messages(value) -> list[dict]:
    return [{"role": m["role"], "content": m["content"]} for m in (value if value is not None else [])]


def sampled_answers(rows: DataFrame, chat: Chat, n: int, info: dict, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """Rows (prompt_id, chosen, ...) with prompt_messages, other_info and gen_answers, without the dialogues.

    The prompt is the chosen dialogue without its last message. Each of n calls that fails is left out, so there may be
    fewer answers. Rows come in any order; key what is done by prompt_id.
    """
    keep = [c for c in rows.columns if c not in ("chosen", "rejected", "messages")]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    own = json.dumps(info)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = [_messages(m)[:-1] for m in batch["chosen"]]
            out = batch[keep].copy()
            out["prompt_messages"] = prompts
            out["gen_answers"] = [[a for _ in range(n) if (a := tried(lambda p=p: chat(p), tries, wait)) is not None] for p in prompts]
            yield out

    filled = rows.mapInPandas(run, f"{fields}, prompt_messages {schemas.MESSAGES}, gen_answers array<string>")
    return filled.withColumn("other_info", F.from_json(F.lit(own), schemas.INFO))


def ranked(rows: DataFrame, ranker: Callable[[list[list[dict]], list[list[str]]], list[list[int]]], batch: int = RANK_ROWS) -> DataFrame:
    """Rows (prompt_messages, gen_answers, ...) with ranks, 1 the best, from a ranker of so many rows at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch].copy()
                own["ranks"] = ranker([_messages(m) for m in own["prompt_messages"]], [list(a) for a in own["gen_answers"]])
                yield own

    return rows.mapInPandas(run, f"{schema}, ranks array<int>")


def answered(questions: DataFrame, chat: Chat, model: str, choices: int = 1, keep_history: bool = False, count: Callable[[str], int] | None = None, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """(question_id, answer_id, model_id, choices) for questions (question_id, turns): each turn is asked with those before it.

    A failed call answers with the mark. With keep_history a choice sees the turns of the choices before. With count turns
    are (content, token_len), else texts.
    """
    turn = "struct<content string, token_len int>" if count else "string"
    key = questions.schema["question_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, turns in zip(batch["question_id"], batch["turns"]):
                history: list[dict] = []
                found = []
                for i in range(choices):
                    history = history if keep_history else []
                    said = []
                    for t in turns:
                        history.append({"role": "user", "content": t if isinstance(t, str) else t["content"]})
                        text = tried(lambda: chat(list(history)), tries, wait)
                        text = FAILED if text is None else text
                        history.append({"role": "assistant", "content": text})
                        said.append({"content": text, "token_len": count(text)} if count else text)
                    found.append({"index": i, "turns": said})
                out.append((q, f"{model}-{q}", model, found))
            yield pd.DataFrame(out, columns=["question_id", "answer_id", "model_id", "choices"])

    return questions.mapInPandas(run, f"question_id {key}, answer_id string, model_id string, choices array<struct<index int, turns array<{turn}>>>")


def outputs(items: DataFrame, chat: Chat, generator: str, tries: int = 3, wait: float = WAIT) -> DataFrame:
    """(instruction, output, dataset, generator) for items (instruction, dataset); a call that fails each time gives ERROR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [tried(lambda i=i: chat([{"role": "user", "content": i}]), tries, wait) for i in batch["instruction"]]
            yield pd.DataFrame({"instruction": batch["instruction"], "output": ["ERROR" if t is None else t for t in texts], "dataset": batch["dataset"], "generator": generator})

    return items.select("instruction", "dataset").mapInPandas(run, "instruction string, output string, dataset string, generator string")


def judged(rows: DataFrame, chat: Chat, prompt: str = "prompt", tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """Rows with judgment: what the judge says to the prompt, the mark where it fails. Verdicts are read by operators.judging."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [tried(lambda p=p: chat([{"role": "user", "content": p}]), tries, wait) for p in batch[prompt]]
            yield batch.assign(judgment=[FAILED if t is None else t for t in texts])

    return rows.mapInPandas(run, f"{schema}, judgment string")


def games(matches: DataFrame, chat: Chat, verdict: Callable[[str], tuple[str | None, bool]], system: str, template: str, pairwise: bool = True, attempts: int = 2) -> DataFrame:
    """(question_id, model, judge, games) for matches (question_id, model, judge, question, answer, baseline_answer).

    In the first game A is the baseline, in the second the places are swapped. A judge that gives no verdict is asked
    again, up to so many attempts, and its texts are joined. verdict gives (score, whether to ask again).
    """
    key = matches.schema["question_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                played = []
                for swapped in (False, True) if pairwise else (False,):
                    a, b = (r.answer, r.baseline_answer) if swapped else (r.baseline_answer, r.answer)
                    asked = template.replace("{question}", r.question).replace("{answer_a}", a).replace("{answer_b}", b)
                    talk, said, score = [{"role": "system", "content": system}, {"role": "user", "content": asked}], "", None
                    for _ in range(attempts):
                        text = chat(list(talk))
                        said = f"{said}\n{text}" if said else text
                        score, again = verdict(said)
                        if not again:
                            break
                        talk += [{"role": "assistant", "content": text}, {"role": "user", "content": "Please go on and end with a verdict."}]
                    played.append({"user_prompt": asked, "judgment": said, "score": score})
                out.append((r.question_id, r.model, r.judge, played))
            yield pd.DataFrame(out, columns=["question_id", "model", "judge", "games"])

    return matches.mapInPandas(run, f"question_id {key}, model string, judge string, games array<struct<user_prompt string, judgment string, score string>>")


def precomputed_logps(rows: DataFrame, logps: Callable[[list[list[int]], list[list[int]]], list[float]]) -> DataFrame:
    """Rows with reference_chosen_logps and reference_rejected_logps, from a model's function of (input_ids, labels); both sides of a batch in one call."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            both = [[*map(list, batch[f"chosen_{c}"]), *map(list, batch[f"rejected_{c}"])] for c in ("input_ids", "labels")]
            found = logps(*both)
            yield batch.assign(reference_chosen_logps=found[:n], reference_rejected_logps=found[n:])

    return rows.mapInPandas(run, f"{schema}, reference_chosen_logps float, reference_rejected_logps float")
