"""Fits models/char_models.npz: ``python -m sparkprep.llm.train.pairs DATA_DIR``.

Languages are learned from the labels of the conversations (some are wrong; naive Bayes does not mind), code from fenced
blocks and from lines the kind model takes for code or tables. At most ``BOUND`` messages are read.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from .. import answer_defects, char_models, text_stats

BOUND = 40_000


def main(data: str) -> None:
    import duckdb

    rows = duckdb.sql(f"""
        SELECT DISTINCT ON (msg_id) msg_id, role, content, substr(lower(lang), 1, 2) FROM '{data}/messages.parquet' m
        JOIN (SELECT DISTINCT conv_id, lang FROM '{data}/conversations.parquet') c USING (conv_id)
        WHERE content IS NOT NULL AND role IN ('user', 'human', 'assistant', 'gpt', 'bot') ORDER BY msg_id""").fetchall()
    rng = random.Random(1)
    rng.shuffle(rows)
    rows = rows[:BOUND]
    names = {"sp": "es", "ge": "de", "fr": "fr", "en": "en", "de": "de", "es": "es"}
    lines, labels = [], []
    for _, _, text, lang in rows:
        for x in answer_defects._FENCED.findall(text):
            for line in x.splitlines():
                lines.append(line)
                labels.append(4)
        if (lang := names.get(lang)) is None:
            continue
        for line in answer_defects._FENCED.sub("\n", text).splitlines():
            if len(line) > 20:
                lines.append(line)
                labels.append(char_models.LANGUAGES.index(lang))
    common = frozenset(w for (w,) in duckdb.sql(f"SELECT DISTINCT word FROM '{data}/common_words.parquet'").fetchall())
    kinds = text_stats.load()
    for s in range(0, len(lines), 20_000):
        own = lines[s : s + 20_000]
        features, _, at, _ = text_stats.line_features(own, common)
        kind = kinds.probabilities(features).argmax(1)
        for i, k in zip(at, kind):
            if text_stats.KINDS[k] in ("code", "table", "junk"):
                labels[s + i] = 4
    table = char_models.fit_languages(lines, labels)
    model = char_models.CharModels(table, *[np.zeros(0)] * 3)
    # labels that the first fit contradicts clearly are mistaken; a second fit leaves them out
    scores = np.concatenate([model.language_scores(lines[s : s + 5000]) for s in range(0, len(lines), 5000)])
    y = np.array(labels)
    sure = scores[np.arange(len(y)), y] > scores.max(1) - 5
    print("lines", len(y), "of each", np.bincount(y), "kept", sure.mean())
    table = char_models.fit_languages([x for x, k in zip(lines, sure) if k], y[sure].tolist())
    ends = char_models.fit_ends([answer_defects.answer_part(t) for _, _, t, _ in rows])
    print("suffixes", len(ends[0]))
    char_models.CharModels(table, *ends).save()


if __name__ == "__main__":
    main(*sys.argv[1:])
