"""Problem 1: prompt and response pairs whose response is unusable, with the type of defect."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import char_models, text_stats
from .char_models import LANGUAGES, CharModels
from .common import THINK_END_MARKERS, map_arrow, side

DEFECTS = ("empty", "truncated", "refusal", "echo", "wrong_language")

#: Turns of one conversation that are put in order together; longer conversations are cut into blocks of so many turns.
TURNS = 1024

_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_WORDS = re.compile(r"[^\W_]+")
_CLOSING = "\"'”’»)]}*_` \t"

#: Language names by which a question asks for another language.
_NAMES = {
    "en": "english|englisch\\w*|anglais|inglés|inglesa", "de": "german|deutsch\\w*|allemand|alemán|alemana",
    "fr": "french|französisch\\w*|français|francés|francesa", "es": "spanish|spanisch\\w*|espagnol|español|española|castellano",
}
_ASKED = {k: re.compile(rf"\b(?:{v})\b") for k, v in _NAMES.items()}


def answer_part(text: str) -> str:
    """What follows the last end marker of reasoning; the whole text if there is none."""
    cut = 0
    for marker in THINK_END_MARKERS:
        if (at := text.rfind(marker)) >= 0:
            cut = max(cut, at + len(marker))
    return text[cut:].replace("<|end_of_solution|>", "") if cut else text


def invisible(text: str) -> bool:
    """No character but white space, controls, format marks and fillers."""
    return all(unicodedata.category(c)[0] in "ZC" or c in "ᅟᅠㅤ⠀️" for c in text)


def is_echo(question: str, answer: str) -> bool:
    """The answer is the question, or its last sentence or paragraph, but for a few edits of words or characters."""
    a = _WORDS.findall(answer.lower())
    if len(a) < 2:
        return False
    whole = _WORDS.findall(question.lower())
    for q in (whole, *(_WORDS.findall(x.lower()) for x in (re.split(r"(?<=[.!?…])\s+", question.strip())[-1], question.strip().rsplit("\n", 1)[-1]))):
        if q and len(a) == 2 * len(q) and a[: len(q)] == a[len(q) :]:
            a = a[: len(q)]  # the question twice
        if not q or not 0.7 <= len(a) / len(q) <= 1.4:
            continue
        if a == q:
            return True
        common = len(set(a) & set(q)) / max(len(set(a)), len(set(q)))
        if common >= 0.6 and _edit_share(" ".join(q), " ".join(a)) <= 0.15:
            return True
    return False


def _edit_share(x: str, y: str, most: float = 0.15) -> float:
    """Edit distance of characters over the greater length; 1 as soon as it must exceed ``most``.

    Only the band of places that few enough edits can reach is computed, row by row in numpy, at any length.
    """
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    if len(a) > len(b):
        a, b = b, a
    k = int(most * len(b)) + 1
    if len(b) - len(a) > k:
        return 1.0
    far = len(b) + k
    row = np.where(np.arange(len(b) + 1) <= k, np.arange(len(b) + 1), far)
    for i, c in enumerate(a, 1):
        low, high = max(i - k, 1), min(i + k, len(b))
        steps = np.arange(high - low + 1)
        best = np.minimum(row[low : high + 1] + 1, row[low - 1 : high] + (b[low - 1 : high] != c))
        first = i if low == 1 else far
        best[0] = min(best[0], first + 1)
        row[low - 1] = first
        row[low : high + 1] = np.minimum.accumulate(best - steps) + steps
        if row[low : high + 1].min() > k and first > k:
            return 1.0
    return row[-1] / max(len(b), 1)


#: Mean log-odds of ``SPAN`` words in a row from which they decline, of a sentence from which it goes with a refusal, and of
#: a word that neither class has.
DECLINES, SUPPORTS, SPAN, UNKNOWN = 2.0, 0.0, 4, -0.4

_MODEL: list[dict[str, float]] = []


def sentences(text: str) -> list[list[str]]:
    """Words in lower case of the sentences of more than two words."""
    parts = re.split(r"(?<=[.!?…])\s+|\n+", text.strip().lower().replace("’", "'"))
    return [w for w in (re.findall(r"[^\W\d_]+", x) for x in parts) if len(w) > 2]


def grams(words: list[str]) -> list[str]:
    return [*words, *map(" ".join, zip(words, words[1:]))]


def refusal_log_odds(words: list[str], odds: dict[str, float]) -> tuple[float, float]:
    """(mean log-odds of a sentence, the greatest of any ``SPAN`` words in a row) to stand in refusals, by words and pairs of words.

    Pairs that the model does not know say nothing beside their words; of a sentence of mostly unknown words nothing is known.
    """
    if 2 * sum(w in odds for w in words) <= len(words):
        return -9.0, -9.0
    own = [odds.get(w, UNKNOWN) for w in words]
    pair = [odds.get(f"{a} {b}") for a, b in zip(words, words[1:])]
    best, n = -9.0, len(words)
    for i in range(max(1, n - SPAN + 1)):
        seen = own[i : i + SPAN] + [x for x in pair[i : i + SPAN - 1] if x is not None]
        best = max(best, sum(seen) / len(seen))
    seen = own + [x for x in pair if x is not None]
    return sum(seen) / len(seen), best


def refuses(answer: str, odds: dict[str, float]) -> bool:
    declined = False
    for words in sentences(answer):
        mean, best = refusal_log_odds(words, odds)
        if best > DECLINES:
            declined = True
        elif mean <= SUPPORTS:
            return False
    return declined


def is_refusal(answer: str) -> bool:
    """An answer of any length in which a sentence declines and every other one declines too, apologizes, explains that or offers other help.

    The verdict is that of a naive Bayes classifier of words and pairs of words, sentence by sentence.
    """
    if not _MODEL:
        with np.load(char_models.MODEL.replace("char_models", "refusal_words")) as f:
            _MODEL.append(dict(zip(f["words"].tolist(), f["odds"].tolist())))
    return refuses(answer, _MODEL[0])


def natural_language(scores: np.ndarray, lengths: np.ndarray) -> tuple[str | None, float]:
    """(language, log-odds to the next) of a text from its lines' scores; lines that look like code do not vote."""
    natural = scores[:, :4].max(1) > scores[:, 4] + 2
    total = scores[natural, :4].sum(0)
    if not natural.any() or lengths[natural].sum() < 12:
        return None, 0.0
    order = np.argsort(total)
    return LANGUAGES[order[-1]], float(total[order[-1]] - total[order[-2]])


_ITEM = re.compile(r"\s*(?:[-*+•‣▪◦·→–—]\s|\[[ xX]\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.):]\s|\*\*[^*]+\*\*\s*[-–:])")
_EMPTY_ITEM = re.compile(r"\s*(?:[-*+•‣▪◦·→–—]|\[[ xX]?\]?|\(?(?:\d{1,3}|[a-zA-Z])[.):])+\s*$")


#: Likelihood from which an end is taken for one: of a text of several sentences, of a list item or bare line, of a single sentence.
LIKELY_END, LIKELY_ITEM, LIKELY_SHORT = 0.2, 0.02, 0.01


def truncation(answer: str, models: CharModels) -> str | None:
    """Why an answer seems to break off: code, formula, list, sentence or word; None if it is complete."""
    text = answer.rstrip()
    text = re.sub(r"[​﻿\s]+$", "", text)
    if not text:
        return None
    if text.count("```") % 2:
        return "code"
    plain = _FENCED.sub(" ", text)
    if not plain.strip() or text.endswith("```"):
        return None
    if (plain.count("$$") % 2) or (re.sub(r"\\\$|\$\$", "", plain).count("$") % 2) or plain.count(r"\begin{") > plain.count(r"\end{") or plain.count(r"\[") > plain.count(r"\]") or plain.count(r"\(") > plain.count(r"\)"):
        return "formula"
    last = text.rsplit("\n", 1)[-1].rstrip()
    tail = last.rstrip(_CLOSING)
    before = text[: len(text) - len(last)].rstrip()
    lines = [x for x in text.splitlines() if x.strip()]
    listed = len(lines) > 1 and (_ITEM.match(last) or _ITEM.match(lines[-2]) or last.startswith(("   ", "\t")))
    if listed and _EMPTY_ITEM.match(last):
        return "list"
    if not tail:
        return None if last.strip(" \t")[-1] not in "([{" else "sentence"
    end = tail[-1]
    if end in ".!?…。！？؟।" or (end in ";,:" and listed):
        return "list" if listed and end in ",:" else None
    if not (end.isalnum() or end in ",;:-–—([{/\\&+=<>_^|'\"%"):
        return None  # emoji, symbols, closed formulas
    if last.rstrip().endswith(("$", r"\]", r"\)", "}")) and r"\end" in last or last.rstrip().endswith("$"):
        return None
    if end in ",:;–—([{\\&" or end == "-" and len(tail) > 1 and tail[-2].isalnum():
        return "sentence"
    # no mark ends the text: the end-of-text likelihood of its last characters decides, by what kind of text it ends
    bare = not listed and len(lines) > 2 and all(x.rstrip()[-1:] not in ".!?" for x in lines[-3:])
    several = re.search(r"[.!?…][\"'”»)]*\s+\S", last) or re.search(r"[.!?…][\"'”»)]*$", before)
    probability = models.end_probability(tail)
    if probability is None:
        return None
    if listed or bare:
        return "list" if probability < LIKELY_ITEM else None
    if several and len(_WORDS.findall(tail)) >= 3:
        return "sentence" if probability < LIKELY_END else None
    if any(c.isdigit() or c == "_" for c in tail.split()[-1]):
        return None  # a short informal answer that names something
    probability = models.end_probability(tail, least=30, shortest=6)
    return "sentence" if probability is not None and probability < LIKELY_SHORT else None


def judge(questions: list[str | None], answers: list[str | None], models: CharModels, common: frozenset[str], kinds: text_stats.BoostedTrees) -> list[str | None]:
    """Defect of each pair, or None."""
    n = len(answers)
    out: list[str | None] = [None] * n
    parts = [answer_part(a) if a else "" for a in answers]
    lines: list[str] = []
    spans: list[tuple[int, int, int]] = []
    for i, a in enumerate(parts):
        if not a or invisible(a):
            out[i] = "empty"
        elif questions[i] and is_echo(questions[i], a):
            out[i] = "echo"
        elif is_refusal(a):
            out[i] = "refusal"
        begin = len(lines)
        if out[i] is None:
            lines += [x for x in _FENCED.sub("\n", questions[i] or "").splitlines() if x.strip()]
            middle = len(lines)
            lines += [x for x in _FENCED.sub("\n", a).splitlines() if x.strip()]
            spans.append((begin, middle, len(lines)))
        else:
            spans.append((begin, begin, begin))
    scores = np.concatenate([models.language_scores(lines[i : i + 4000]) for i in range(0, len(lines), 4000)]) if lines else np.zeros((0, len(LANGUAGES)))
    lengths = np.array([len(x) for x in lines])
    doubtful: list[int] = []
    for i, (a, b, c) in enumerate(spans):
        if out[i] is not None:
            continue
        answer, question = parts[i], questions[i] or ""
        if b > a and c > b:
            spoken, answer_odds = natural_language(scores[b:c], lengths[b:c])
            asked, question_odds = natural_language(scores[a:b], lengths[a:b])
            script, asked_script = char_models.script_of(answer), char_models.script_of(question)
            spoken, asked = script or spoken, asked_script or asked
            if spoken and asked and spoken != asked and (script or answer_odds > 8) and (asked_script or question_odds > 8):
                wanted = question.lower()
                if spoken not in _ASKED or not _ASKED[spoken].search(wanted):
                    out[i] = "wrong_language"
        if out[i] is None and truncation(answer, models):
            out[i] = "truncated"
        if out[i] is not None:
            doubtful.append(i)
    for s in range(0, len(doubtful), 500):
        part = [i for i in doubtful[s : s + 500]]
        for i, (kind, last, _) in zip(part, _line_kinds([parts[i] for i in part], common, kinds)):
            if kind in ("list", "table", "junk") or (out[i] == "truncated" and last in ("code", "table", "junk") and truncation(parts[i], models) != "code"):
                out[i] = None
    spoken = [i for i in doubtful if out[i] == "wrong_language"]
    for s in range(0, len(spoken), 500):
        part = spoken[s : s + 500]
        for i, (_, _, prose) in zip(part, _line_kinds([questions[i] or "" for i in part], common, kinds)):
            if natural_language(models.language_scores(prose), np.array([len(x) for x in prose]))[0] is None and not char_models.script_of("".join(prose)):
                out[i] = None  # the question has no natural language
    return out


def _line_kinds(texts: list[str], common: frozenset[str], kinds: text_stats.BoostedTrees) -> list[tuple[str, str, list[str]]]:
    """(kind of the greater part, kind of the last line, lines of prose) of each text."""
    features, weight, at, lines = text_stats.line_features(texts, common)
    out: list[tuple[str, str, list[str]]] = [("prose", "prose", [])] * len(texts)
    if len(at):
        kind = kinds.probabilities(features).argmax(1)
        for i in np.unique(at):
            own = np.flatnonzero(at == i)
            mass = np.bincount(kind[own], weight[own], len(text_stats.KINDS))
            prose = [lines[j] for j in own if text_stats.KINDS[kind[j]] == "prose"]
            out[i] = (text_stats.KINDS[int(mass.argmax())] if mass.max() > mass.sum() / 2 else "prose", text_stats.KINDS[kind[own[-1]]], prose)
    return out


def answer_pairs(messages: DataFrame) -> DataFrame:
    """(msg_id, answer, question, asked): assistant messages with the nearest earlier user message of their conversation.

    Messages are ordered by turn, then msg_id; a message that was delivered repeatedly counts once. Answers without an
    earlier user message, and messages without a conversation, have no row. Conversations are hash-partitioned in blocks of ``TURNS``
    turns, so that one very long conversation does not fall into one task; the last user message of earlier blocks is joined
    to the blocks that begin without one, whose partitioning is that of the join.
    """
    base = messages.select("msg_id", "conv_id", "turn", side(F.col("role")).alias("who"), "content").where("who is not null and conv_id is not null")
    base = base.select("*", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / TURNS).alias("block"))
    w = W.partitionBy("conv_id", "block").orderBy("turn", "msg_id")
    question = F.last(F.when(F.col("who") == "user", F.struct(F.col("content").alias("text"))), ignorenulls=True).over(w)
    ordered = base.select("*", question.alias("question"), F.lag("msg_id").over(w).alias("before"))
    answers = ordered.where("who = 'assistant' and (before is null or before <> msg_id)").drop("before", "who", "turn")
    # the last question of each block comes from the same exchange; one row a block is moved
    blocks = ordered.groupBy("conv_id", "block").agg(F.max_by("question", F.struct("turn", "msg_id")).alias("own"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
    answers = answers.join(carried, ["conv_id", "block"], "left").withColumn("question", F.coalesce("question", "carried"))
    return answers.where("question is not null").select("msg_id", F.col("content").alias("answer"), F.col("question.text").alias("question"))


def answer_defects(messages: DataFrame, common_words: frozenset[str]) -> DataFrame:
    """(msg_id, defect) of the defective answers of ``answer_pairs``.

    A null answer is empty; a null question has no language and is never echoed. Answers that are for the greater part a
    list, a table or junk are no cases but for being empty, refusals or echoes.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        models, kinds = char_models.load(), text_stats.load()
        answers, questions = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found: list[str | None] = []
        for i in range(0, len(answers), 1000):
            found += judge(questions[i : i + 1000], answers[i : i + 1000], models, common_words, kinds)
        at = [i for i, x in enumerate(found) if x]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([found[i] for i in at], pa.string())], ["msg_id", "defect"])

    return map_arrow(answer_pairs(messages), run, "msg_id bigint, defect string")
