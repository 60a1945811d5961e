"""Quality rules: line-first cleaning, then rejection of documents that lose too much text.

Every line is judged on its own (symbols, navigation, boilerplate, punctuation); failing lines go; a
document is rejected when its base rules fail or the failing lines hold more than `max_lost` of its words.
A line without a sentence end, or with more than two thirds of its words after the last one, fails by punctuation.
The work is one map over whole texts: no shuffle, memory bounded by one Arrow batch.

Null or empty text: no words, so base_failed is true and kept false. Repeated rows: one result each.
Ties between repeated lines or windows: all count alike. Empty table: empty result. Extra columns: ignored, or handed
through by `clean_documents`. Very long texts: judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, as_bytes

#: Characters counted as symbols by the contract.
SYMBOLS = b"#*$%&|<>"
#: Sentence ends of the scripts met in web text.
TERMINALS = ".!?…。！？；:;।؟۔"
CLOSERS = "\"')]}»”’›」』）"
#: Phrases of page furniture in the languages of the corpus, in lower case; a short line holding one is boilerplate.
BOILERPLATE = (
    # English
    "accept all cookies", "we use cookies", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "sign up for our newsletter", "subscribe to our", "enable javascript", "javascript is disabled", "click here to",
    "share on facebook", "share on twitter", "follow us on", "skip to content", "back to top", "lorem ipsum",
    "page not found", "all rights reserved",
    # German
    "alle cookies akzeptieren", "wir verwenden cookies", "diese website verwendet cookies", "datenschutzerklärung",
    "allgemeine geschäftsbedingungen", "newsletter abonnieren", "bitte aktivieren sie javascript", "zum inhalt springen",
    "nach oben scrollen", "seite nicht gefunden", "alle rechte vorbehalten",
    # French
    "accepter tous les cookies", "nous utilisons des cookies", "politique de confidentialité", "mentions légales",
    "conditions générales d'utilisation", "abonnez-vous à notre", "veuillez activer javascript", "aller au contenu",
    "retour en haut", "page introuvable", "tous droits réservés",
    # Spanish
    "aceptar todas las cookies", "utilizamos cookies", "política de privacidad", "política de cookies", "aviso legal",
    "términos y condiciones", "suscríbete a nuestro", "habilite javascript", "saltar al contenido", "volver arriba",
    "página no encontrada", "todos los derechos reservados",
)
#: Separators between links, or a line that is one word of a menu (English, German, French, Spanish).
NAVIGATION = re.compile(
    r"\s[|›»·•/>]\s|^\s*(?:home|menu|login|log in|sign in|search|next|previous"
    r"|startseite|menü|anmelden|suche|weiter|zurück|accueil|connexion|rechercher|suivant|précédent"
    r"|inicio|menú|iniciar sesión|buscar|siguiente|anterior)\s*$",
    re.I,
)

_STRAY = bytes(range(0x80, 0xC0))
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_TERMINAL = re.compile(f"[{re.escape(TERMINALS)}][{re.escape(CLOSERS)}]*(?:\\s|$)")

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words found at least twice; windows compare exactly, by ids."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    code, base = ids[: n - width + 1].copy(), len(seen)
    for j in range(1, width):
        if int(code.max()) > (2**62) // base:
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + ids[j : n - width + 1 + j]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks[:n]) > 0).sum())


def line_fails(line: bytes, n_words: int) -> str | None:
    """Name of the first rule that a line with words breaks, else None."""
    if len(line) - len(line.translate(None, SYMBOLS)) > 0.5 * n_words and n_words > 2:
        return "symbols"
    text = line.decode("utf-8", "replace")
    if (cuts := len(NAVIGATION.findall(text))) and 3 * (cuts + 1) >= n_words:
        return "navigation"
    if n_words <= 25 and _FURNITURE.search(text.lower()):
        return "boilerplate"
    if n_words > 2 and 3 * trailing_words(text) > 2 * n_words:
        return "punctuation"
    return None


def trailing_words(text: str) -> int:
    """Words of a line after its last sentence end: none in a whole sentence, all where no sentence ends."""
    end = 0
    for found in _TERMINAL.finditer(text):
        end = found.end()
    return len(text[end:].encode("utf-8", "replace").split())


def judge(raw: bytes, max_lost: float) -> tuple[tuple, bytes]:
    """The contract's figures and verdict of one text, and the text without its failing lines."""
    words = raw.split()
    n, kept_lines, seen, dup, lost = len(words), [], set(), 0, 0
    for line in raw.split(b"\n"):
        k = len(line.split())
        if not k:
            kept_lines.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if line_fails(line, k):
            lost += k
        else:
            kept_lines.append(line)
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    chars = len(raw.translate(None, SPACES + _STRAY))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (n, chars, symbols, dup, repeats, failed, not failed and lost <= max_lost * n), b"\n".join(kept_lines)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, with_text: bool = False) -> DataFrame:
    """Per row: its id, the figures of COLUMNS, and with `with_text` the cleaned text as `clean_text`."""
    spec = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(raw or b"", max_lost) for raw in as_bytes(batch.column(1))]
            cols = list(zip(*(f[0] for f in found), strict=True)) or [[]] * 7
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            if with_text:
                arrays.append(pa.array([f[1] for f in found], pa.binary()).cast(pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = spec.schema["doc_id"].dataType.simpleString()
    return spec.mapInArrow(work, f"doc_id {kind}, {COLUMNS}" + ", clean_text string" * with_text)


def clean_documents(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """`docs` (columns of documents) without rejected rows, each text without its failing lines, n_chars to match.

    One map that hands every other column through, so no join brings the verdict back to the rows.
    """
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(raw or b"", max_lost) for raw in as_bytes(batch.column(at_text))]
            stays = pa.array([f[0][6] for f in found], pa.bool_())
            arrays = list(batch.columns)
            arrays[at_text] = pa.array([f[1] for f in found], pa.binary()).cast(pa.string())
            if at_chars is not None:
                arrays[at_chars] = pa.array([len(f[1].translate(None, _STRAY)) for f in found], batch.column(at_chars).type)
            yield pa.RecordBatch.from_arrays(arrays, names).filter(stays)

    return docs.mapInArrow(work, docs.schema)
