"""Quality rules, lines first: lines that fail a rule go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm import words
from kinespark.llm._common import map_texts

#: A document is rejected if its removed lines have more than this share of its words.
MOST_LOST = 0.5
#: A line is navigation if it has so many separators at least, and one for so many words at most.
SEPARATORS, WORDS_A_SEPARATOR = 3, 4
#: A line of so many words at least fails if it has no sentence punctuation at all.
LONG_LINE = 12
#: A line fails if more than this share of its characters, white space aside, are neither letters nor digits.
MOST_MARKS = 0.4
#: A boilerplate line has so many words at most.
BOILERPLATE_WORDS = 25
#: Phrases of boilerplate by language, as regular expressions that Python and RE2 read alike.
PHRASES = {
    "en": ["all rights reserved", "terms (?:of|and) (?:use|service|conditions)", "privacy policy", "cookie policy", "use of cookies", "accept (?:all )?cookies", "enable javascript", "javascript is (?:disabled|required)", "click here", "read more", "sign up now", "log ?in to (?:view|continue)", "subscribe to our", "share (?:this )?on (?:facebook|twitter)", "powered by", "skip to (?:main )?content", "back to top"],
    "de": ["alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerkl(?:ä|ae)rung", "cookie-richtlinie", "cookies akzeptieren", "verwendung von cookies", "javascript (?:ist deaktiviert|aktivieren)", "hier klicken", "weiterlesen", "jetzt anmelden", "newsletter abonnieren", "teilen auf (?:facebook|twitter)", "zum (?:hauptinhalt|seitenanfang)", "impressum"],
    "fr": ["tous droits réservés", "conditions (?:générales )?d'utilisation", "politique de confidentialité", "politique de cookies", "accepter les cookies", "utilisation de cookies", "active[rz] javascript", "cliquez ici", "lire la suite", "inscrivez-vous", "abonnez-vous à", "partager sur (?:facebook|twitter)", "aller au contenu", "haut de page", "mentions légales"],
    "es": ["todos los derechos reservados", "términos (?:de|y) (?:uso|servicio|condiciones)", "política de privacidad", "política de cookies", "aceptar (?:las )?cookies", "uso de cookies", "habilit[ae]r? javascript", "haga clic aquí", "leer más", "regístrese ahora", "suscríbase a", "compartir en (?:facebook|twitter)", "saltar al contenido", "volver arriba", "aviso legal"],
    "": ["lorem ipsum"],
}
BOILERPLATE = "|".join(p for phrases in PHRASES.values() for p in phrases)
#: Separators of navigation: these characters anywhere, and these words.
SEPARATOR_CHARS, SEPARATOR_WORDS = "|»›•·¦", (">", "/", "::")
SENTENCE = ".!?…:;,。！？"
_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE)
_SENTENCE, _SEPARATOR = re.compile(f"[{SENTENCE}]"), re.compile(f"[{SEPARATOR_CHARS}]")
_MARK = re.compile(r"[^\w\x20\x09-\x0D]|_")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LETTER_BYTES = (np.arange(256) & 0xC0) != 0x80  # the first byte of each code point
_LETTER_BYTES = (_LETTER_BYTES & ~np.isin(np.arange(256), [0x20, *range(9, 14)])).astype(np.int64)


def line_fails(line: str, n_words: int) -> str | None:
    """The rule that the line fails: navigation, boilerplate, marks or punctuation; None if it passes. Blank lines pass."""
    if not n_words:
        return None
    found = _WORD.findall(line)
    separators = len(_SEPARATOR.findall(line)) + sum(map(found.count, SEPARATOR_WORDS))
    if separators >= SEPARATORS and separators * WORDS_A_SEPARATOR >= n_words:
        return "navigation"
    if n_words <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    size = sum(map(len, found))
    if size >= 10 and 10 * len(_MARK.findall(line)) > 10 * MOST_MARKS * size:
        return "marks"
    if n_words >= LONG_LINE and not _SENTENCE.search(line):
        return "punctuation"
    return None


def counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text: n_words, word_chars, n_symbols, n_repeat_words."""

    def total(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=sums[1:])
        return np.diff(sums[bounds])

    starts, ends, first = words.spans(data, bounds)
    row = words.rows_of(first)
    n_words = np.diff(first)
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        inside = row[2:] == row[:-2]
        windows = words.shingles(words.hashes(data, starts, ends, lower=False), 3)
        windows = words.mix(windows ^ (row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[inside]
        at = np.flatnonzero(inside)
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    return {"n_words": n_words, "word_chars": total(_LETTER_BYTES), "n_symbols": total(_SYMBOL), "n_repeat_words": np.bincount(row[repeated], minlength=len(n_words)).astype(np.int64)}


def clean(text: str) -> tuple[str, int, int, int, int]:
    """The text without the lines that fail, lines dropped, words in all, words dropped, and lines with a word equal to an earlier line."""
    kept, seen, dropped, n_all, n_lost, again = [], set(), 0, 0, 0, 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            again += line in seen
            seen.add(line)
        n_all += n
        if line_fails(line, n):
            dropped += 1
            n_lost += n
        else:
            kept.append(line)
    return "\n".join(kept), dropped, n_all, n_lost, again


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines_removed, n_words_removed and kept.

    base_failed: under 50 words, or over half of them in 3-word windows that occur twice or more. kept: not base_failed,
    and the lines that line_fails() removes have no more than MOST_LOST of the words. The counts are of the whole text
    before cleaning. A null text counts as empty (no words, so it fails); its clean_text is empty. Texts of any length are
    read whole, in memory and time in proportion to them. Ids may repeat or be null; other columns are not read. An empty
    table gives an empty result.
    """

    names = ["id", "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in words.groups(batch.column(1)):
                n = len(bounds) - 1
                found, raw = counts(data, bounds), data.tobytes()
                cleaned = [clean(raw[a:b].decode("utf-8", "replace")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                text, removed, _, lost, again = zip(*cleaned, strict=True)
                more = {"n_dup_lines": again, "n_lines_removed": removed, "n_words_removed": lost} | found
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(text, pa.string()), *[pa.array(np.asarray(more[c], np.int64)) for c in names[2:]]], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, clean_text string, " + ", ".join(f"{c} long" for c in names[2:])
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    kept = ~F.col("base_failed") & (F.col("n_words_removed") <= MOST_LOST * n)
    out = rows.transform(map_texts, run, schema).withColumn("base_failed", failed).withColumn("kept", kept)
    return out.select(F.col("id").alias(id_col), "clean_text", *names[2:7], "base_failed", "n_lines_removed", "n_words_removed", "kept")
