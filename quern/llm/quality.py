"""Per-document text quality statistics, and the share of a text that is running prose.

A text is cut into lines, lines are joined to paragraphs (hard-wrapped sentences become whole again), and
paragraphs are cut into sentences.  Combined rules decide which sentences run: enough words, a proper
beginning (in scripts that have capitals), a plausible share of function words, few symbols, little repetition
inside the sentence; lines of lists, tables, logs, code and listings never count.  Repetition statistics of the
whole text decide as well: sentences said three times or more that fill a quarter of it do not count, nor does
anything in a text that one repeated run of three words makes up.

Defined results: null and blank texts have zero counts and null shares, and are never reported as junk;
repeated rows give repeated statistics (``find_non_prose`` gives each id once); other columns are ignored;
very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import INVISIBLE

# Function words of languages that the table of common words does not cover.
DUTCH = "de het een en van in is dat op te zijn met voor niet aan er om als dan door over bij ook uit tot naar maar was werd wordt worden nog al zodra omdat wanneer waarom we die deze dit heeft hebben kan"
ITALIAN = "il lo la i gli le di a da in con su per tra e o che non un una uno del della dei delle al alla ma se come anche più viene prima dopo quando perché mai senza abbiamo ha è nel nella si questo sia nessuno resta"
MORE_ENGLISH = "while who whose what how why where does do did should could would may must will never nobody them their its he she i my me us any some no about into over until than yet still too also once every most much more many two three first new old been being has were"
MORE_GERMAN = "ein eine einen einem einer dem des im am auf für dass sich sind hat haben werden bevor bitte mehr wie oder als bis bei aus nur bleibt"
MORE_FRENCH = "du au aux une se ce cette qui pour sur avec sans plus a été pas elle ils sont était faut puis où leur"
MORE_SPANISH = "los las una al del le su sus para sin más está este esta como pero han sido ser hemos hasta sobre ni había"

#: Least words of a sentence, and of one that begins in lower case; least Han characters of one; share of function words between which a sentence is plausible.
MIN_WORDS, LOWER_WORDS, MIN_HAN, COMMON_LOW, COMMON_HIGH = 5, 8, 8, 0.12, 0.72
#: Words of a stretch in which repetition is measured; words above which a sentence without function words needs this share of short words.
STRETCH, SALAD_WORDS, SHORT_SHARE = 60, 8, 0.08
#: Share of a text above which repeated sentences, or the most frequent run of three words, are debris.
REPEATED, DOMINANT = 0.25, 0.3

_TOKEN = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?")
_HAN = re.compile(r"[㐀-鿿]")
#: Scripts written without spaces (Han, kana, Thai, Lao, Myanmar, Khmer), and kana alone.
_SPACELESS = re.compile(r"[㐀-鿿ぁ-ヿ฀-໿က-႟ក-៿]")
_KANA = re.compile(r"[ぁ-ヿ]")
_LIST = re.compile(r"\s*(?:[-*•+–·▪◦‣]\s|\(?\d{1,3}[.)]\s|#\.\s|\[[ xX]?\]\s|[a-z]\)\s)")
_QUOTE = re.compile(r"\s*(?:>+|\|+|--|//+|;+|#+|%+|\*)\s+")
_TABLE = re.compile(r"^\|.*\||\|$|\S\s+\|\s|\t|\S {3,}\S|^[-+=|:_~*#. ]+$")
_LOG = re.compile(r"\s*(?:\d{4}-\d\d-\d\d|\d{9,13}\b|\d\d:\d\d:\d\d|\[?\d\d?/\w{3}/|(?:DEBUG|INFO|WARN|ERROR|FATAL|TRACE)\b|0x[0-9a-f]+\b|[0-9a-f]{8}\s)")
_CODE = re.compile(r"[{}]\s*$|[=)\]]\S*;\s*$|^\s*(?:def |func |fn |pub |class |import |from \S+ import|return\b|if \(|for \(|while \(|const |let |var |void |int |char |bool |public |private |static |#include|@\w+$)|\w\(.*\)\s*(?:->.*)?[:{;]?\s*$|^\s{4,}\S.*[)=:]$|=>|&&|\|\||==|:=|->")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|(?<=[。！？।॥؟۔።])\s*|\s+(?=[㐀-鿿])")
_DASH = re.compile(r"\s+-\s+")
_CAPITAL = re.compile(r"(?<=[^\W\dA-Z])\s+(?=[A-Z][a-z]*\s+[a-z])")
_WORDLIKE = re.compile(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+|\w*_\w*|(?:[A-Z][a-z]+){2,}|[a-z]+(?:[A-Z][a-z]+)+")
_STOP = re.compile(r"[.!?…](?:\s|$)|[。！？।॥؟۔።]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-’‘“”«»…。，！？、：；]")
_PAUSE = re.compile(r"[,;:()]|\s[-–—]\s")
_CLOSE = (".", "!", "?", "…", "。", "！", "？", "।", "॥", "؟", "۔", "።")
_END = (*_CLOSE, ":", ";", '."', '!"', '?"')


class Judge:
    """Statistics of one text, given the common words."""

    def __init__(self, common: set[str]) -> None:
        self.common = common
        extra = " ".join((DUTCH, ITALIAN, MORE_ENGLISH, MORE_GERMAN, MORE_FRENCH, MORE_SPANISH)).split()
        self.function = {w for w in common if not _HAN.search(w)} | set(extra)
        self.han_common = {w for w in common if _HAN.search(w)}

    def sentence_runs(self, s: str) -> bool:
        """Whether one joined sentence is running prose."""
        s = s.replace("`", "").replace("*", "")
        if not s.isascii():
            spaceless = len(_SPACELESS.findall(s))
            if spaceless * 2 > len(s) * 0.8 and spaceless >= MIN_HAN:
                han = len(_HAN.findall(s))
                return len(set(s)) > 5 and (han < spaceless or _KANA.search(s) is not None or sum(s.count(w) for w in self.han_common) >= 1)
            s = "".join(c for c in s if unicodedata.category(c) not in ("Mn", "Mc"))  # vowel signs are no word breaks
        words = _TOKEN.findall(s)
        n = len(words)
        if n < MIN_WORDS or (n > 45 and not s.endswith(_CLOSE)):
            return False
        begin = s.lstrip("\"'«“‘([¿¡*_ ")
        first, closed = begin[:1], s.endswith(_CLOSE) and not s.endswith("..")
        caseless = first.isalpha() and first.lower() == first.upper()
        proper = first.isupper() or first.isdigit() or caseless or re.match(r"\w*(?:_|[a-z][A-Z])\w", begin) is not None
        if not proper and not (closed and LOWER_WORDS <= n <= 60):
            return False
        low = [w.lower() for w in words]
        share = sum(w in self.function or w.partition("'")[2] in self.function or w.partition("'")[0] + "'" in ("l'", "d'", "qu'", "n'", "c'", "s'") for w in low) / n
        if share > COMMON_HIGH:
            return False
        if share < COMMON_LOW and sum(_WORDLIKE.fullmatch(w) is not None for w in words) < 0.8 * n:
            return False
        if share < COMMON_LOW and not ((first.isupper() or caseless) and n > MIN_WORDS + (0 if closed else 2)):
            return False
        if share == 0 and n > SALAD_WORDS and s.isascii() and not _PAUSE.search(s) and sum(len(w) <= 3 for w in words) < SHORT_SHARE * n:
            return False  # long, without a pause and without any of the small words that every language has
        if not proper and not 0.2 <= share <= 0.66:
            return False
        if len(_SYMBOL.findall(s)) > 0.05 * len(s) or s.count(",") > 0.4 * n:
            return False
        if sum(map(len, words)) < 0.5 * len(s):
            return False
        # Repetition inside the sentence, by stretches, as long sentences come back to their small words.
        if n <= STRETCH:
            return not (n > 30 and len(set(low)) < 0.5 * n) and not (n >= 16 and len(set(low)) < 0.4 * n)
        stretches = [len(set(low[k : k + STRETCH])) for k in range(0, n - STRETCH + 1, STRETCH)]
        return sum(stretches) >= 0.4 * STRETCH * len(stretches)

    def prose_chars(self, text: str) -> int:
        """Characters of ``text`` (already unfolded) that lie in running sentences."""
        sentences: list[str] = []
        paragraph: list[str] = []
        marked = 0

        def close() -> None:
            nonlocal marked
            if paragraph:
                self._cut(paragraph, marked, sentences)
                paragraph.clear()
            marked = 0

        lines = text.split("\n")
        fenced = code = False
        for k, line in enumerate(lines):
            s = line.strip()
            if s.startswith(("```", "~~~")):
                # a mark after code that was never opened closes it, as does one before a sentence
                fenced = not fenced and not code and not self._reads(lines, k + 1)
                close()
                code = False
                continue
            if not s:
                close()
                if fenced:  # a listing that was cut off before its closing mark
                    fenced = not self._reads(lines, k + 1)
                continue
            if fenced:
                continue
            code = _CODE.search(s) is not None
            if (_LIST.match(s) and not line.startswith(" * ")) or _LOG.match(s) or _TABLE.search(s) or code:
                close()
                continue
            m = _QUOTE.match(s)
            if m:
                marked += 1
                s = s[m.end() :]
            paragraph.append(s)
        close()
        counts = Counter(sentences)
        # Sentences over and over are debris, however well they read; so is a text one run of words makes up.
        over = sum(c * (len(s) + 1) for s, c in counts.items() if c >= 3)
        worn = over >= REPEATED * len(text)
        if self.dominant(text.lower().split()) > DOMINANT:
            return 0
        return sum(c * (len(s) + 1) for s, c in counts.items() if not (worn and c >= 3) and self.sentence_runs(s))

    @staticmethod
    def dominant(words: list[str]) -> float:
        """Share of the letters of a text that its most voluminous repeated run of three words covers."""
        if len(words) < 6 or len(set(words)) > (1 - DOMINANT / 3) * len(words):
            return 0.0  # too many different words for any run to cover as much
        letters = sum(map(len, words))
        return max((min(1.0, c * sum(map(len, g)) / letters) for g, c in Counter(zip(words, words[1:], words[2:])).items() if c > 1), default=0.0)

    @staticmethod
    def _reads(lines: list[str], k: int) -> bool:
        """Whether the next line with text looks like a sentence."""
        after = ""
        while k < len(lines) and not after:
            after, k = lines[k].strip(), k + 1
        return (after[:1].isupper() and after.count(" ") >= 4 or len(_HAN.findall(after)) >= MIN_HAN) and not _CODE.search(after)

    def _cut(self, lines: list[str], marked: int, out: list[str]) -> None:
        if marked == len(lines) and marked > 1:
            ends = sum(l.endswith((",", ";", ".", ")")) for l in lines)
            if ends == len(lines):  # quoted list entries, one per line
                return
        if len(lines) >= 3 and sum(l.count(" ") + 1 for l in lines) < 6.5 * len(lines) and sum(l[:1].isupper() for l in lines) > 0.8 * len(lines):
            return  # entries without marks, one per line
        if len(lines) >= 4 and sum(l.count(" ") + 1 for l in lines) < 6.5 * len(lines) and not any(_STOP.search(l) for l in lines):
            return  # short lines without any full stop: entries or shreds
        run = ""
        for k, l in enumerate(lines):
            if run and (l[:1].isupper() or l[:1].isdigit()) and not run.endswith(_END):
                # A capital after an open line: a new sentence if the open one is whole without its closing mark,
                # which shows in lines of uneven length; hard-wrapped text fills its lines evenly.
                if self.sentence_runs(l) and self.sentence_runs(run) and not self._wrapped(lines):
                    out.append(run)
                    run = l
                    continue
            run = f"{run} {l}" if run else l
        for s in _SPLIT.split(run):
            s = s.strip() if s else ""
            if s.count(" ") > 45 and not s.endswith((".", "!", "?", "…")):
                # sentences that lost their marks: dashes stand for them, or a capital after a small word
                out.extend(x for x in (_DASH if " - " in s else _CAPITAL).split(s) if x)
            elif s:
                out.append(s)

    @staticmethod
    def _wrapped(lines: list[str]) -> bool:
        most = max(map(len, lines))
        body = lines[:-1]
        if sum(l[:1].isupper() or l[:1].isdigit() for l in lines) > 0.85 * len(lines):
            return False  # every line begins a sentence
        return len(body) >= 2 and most <= 100 and sum(len(l) > 0.72 * most for l in body) > 0.8 * len(body)

    def statistics(self, text: str | None) -> tuple:
        if text is None or not text.strip():
            return (0, None, None, None, None, None, None, None, None)
        t = unfold(text)
        low = t.lower()
        words = low.split()
        n = len(words)
        letters = sum(map(len, words))
        bare = [w.strip(".,;:!?\"'()[]<>*_`") for w in words]
        lines = [l.strip() for l in t.split("\n") if l.strip()]
        paragraphs = [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]
        grams = Counter(zip(bare, bare[1:], bare[2:]))
        top, times = max(grams.items(), key=lambda kv: (kv[1] * sum(map(len, kv[0])), kv[0])) if grams else ((), 0)
        return (
            n,
            letters / n if n else None,
            len(_SYMBOL.findall(t)) / len(t),
            sum(l.endswith(_END) for l in lines) / len(lines) if lines else None,
            sum(w in self.common for w in bare) / n if n else None,
            1 - len(set(lines)) / len(lines) if lines else None,
            1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else None,
            min(1.0, times * sum(map(len, top)) / letters) if letters and times > 1 else 0.0,
            min(1.0, self.prose_chars(t) / len(t)),
        )

    def prose_share(self, text: str | None) -> float | None:
        if text is None or not text.strip():
            return None
        t = unfold(text)
        return min(1.0, self.prose_chars(t) / len(t)) if t.strip() else 0.0


def unfold(text: str) -> str:
    """Character references resolved, wide letters narrowed, invisible characters removed, line ends unified."""
    t = html.unescape(text) if "&" in text else text
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if not t.isascii():
        t = t.translate(INVISIBLE).replace("\u00a0", " ").replace("\u3000", " ")
        if re.search("[\uff01-\uff5e]{2}", t):
            wide = len(re.findall("[\uff21-\uff3a\uff41-\uff5a]", t))
            t = unicodedata.normalize("NFKC", t) if wide else t
    return t


STATISTICS = (
    "word_count long, mean_word_length double, symbol_ratio double, lines_ending_in_punctuation double, common_word_share double, "
    "duplicate_line_share double, duplicate_paragraph_share double, top_trigram_share double, prose_share double"
)


def _common(common_words: DataFrame) -> set[str]:
    """The reference words: a fixed list of function words, which does not grow with the documents."""
    return {r.w for r in common_words.select(F.lower("word").alias("w")).where("w IS NOT NULL").distinct().collect()}


def document_statistics(documents: DataFrame, common_words: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All statistics per row, computed where the rows lie: no shuffle."""
    common = _common(common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(common)
        for batch in batches:
            rows = [judge.statistics(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 9
            arrays = [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id, *(c.split()[0] for c in STATISTICS.split(", "))])

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"`{id}` {kind}, {STATISTICS}")


def find_non_prose(documents: DataFrame, common_words: DataFrame, least: float = 0.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of texts, neither null nor blank, whose prose share is below ``least``."""
    common = _common(common_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(common)
        for batch in batches:
            shares = [judge.prose_share(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([s is not None and s < least for s in shares], pa.bool_()))], names=[id])

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(f"`{id}`", f"`{text}`").mapInArrow(run, f"`{id}` {kind}").distinct()
