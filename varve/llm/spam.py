"""Problem 8: keyword-stuffed and link-list pages, by the perplexity of word-class sequences.

A page's own text (without quotes and signature) becomes a sequence of symbols: function words by class,
other words by shape, and punctuation, links, tags. An n-gram model of such sequences is counted over the
sentences of all pages that read as prose (they start with a capital, end like a sentence and have function
words); its table, whose size the symbols bound, scores every page twice:

* the perplexity of every sentence or part of a line under the whole n-grams marks stretches that prose does not
  run like, abnormally high or low;
* the perplexity of those stretches' word classes under the single classes, order aside, tells what they are: keywords,
  links and tags lack the mix of function words that prose has (abnormally low or high), while sentences with their
  words in disorder have it.

A page is stuffed if the stretches that are abnormal in both hold enough of its words and entries. The model decides
on that; of an abnormal stretch it is then checked that it is no program output, table of numbers or list of codes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.words import COMMENT, _visible
from varve.session import Scratch

# Function words of English, French, Spanish and German by class.
FUNCTION_WORDS = {
    "D": "the a an this that these those every each some any no my your our their his her its another other le la les un une des du cette ce ces mon ma mes notre nos votre tout chaque el los las una unos unas esta este estos mi su sus nuestro nuestra der die das den dem ein eine einen einem einer kein keine mein meine unser unsere diese dieser dieses jede jeder",
    "R": "i you he she it we they me him us them somebody nobody anyone someone everybody who whom which what je tu il elle nous vous ils elles on qui que quoi yo ella nosotros ellos ellas alguien nadie quien ich du er sie es wir ihr jemand niemand mich mir uns man",
    "P": "of in on at by for from with without between after before to into over under about near next until than as through de à au aux dans sur avec sans pour par entre après avant en con sin por para sobre entre desde hasta del al mit ohne von vom zu zum zur im in am an auf für nach vor bei aus über unter",
    "K": "and or but if when while because so since nor whether et ou mais si quand parce lorsque y o pero cuando porque mientras und oder aber wenn weil dass als ob denn",
    "V": "is are was were be been being am has have had do does did can could will would shall should may might must est sont était étaient sera a ai avons avez ont été avait es son era eran fue ha han he hemos sido está estaba queda ist sind war waren wird werden wurde wurden hat habe haben hatte bleibt kann muss bin",
    "N": "not never no yes only too very more most still again already there here then now just simply ne pas plus jamais encore très toujours no nunca muy más ya también aún nicht nie sehr noch schon nur immer auch",
}
CLASS_OF = {word: name for name, listed in reversed(FUNCTION_WORDS.items()) for word in listed.split()}
ORDER = 5
ENTRIES = 6
SHARE = 2 / 3
SIGNATURE_WORDS = 60
HIGH, LOW = 1.6, 0.25

BREAK = re.compile(r"<\s*(?:br|p|/p|div|/div|hr|li|/li|tr|/tr|ul|/ul)\b[^<>]*>", re.I)
QUOTE = re.compile(r"\[quote(?:=[^\[\]]*)?\]|\[/quote\]|<blockquote[^<>]*>|</blockquote>", re.I)
CODE = re.compile(r"<(code|pre)>.*?</\1>|\[code\].*?\[/code\]", re.I | re.S)
ANCHOR = re.compile(r"<a\b[^<>]*href=([^<>]*)>(.*?)</a>|\[url=([^\[\]]*)\](.*?)\[/url\]", re.I | re.S)
BULLET = re.compile(r"^\s*(?:\d+[.)]|[*\u2022+-])\s+")
IMAGE = re.compile(r"\[img\].*?\[/img\]|<img\b[^<>]*>", re.I | re.S)
OTHER_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?(?:url|img|code|list|size|color|email|b|i|u|s|\*)(?:=[^\[\]]*)?\]", re.I)
SIGNATURE = re.compile(r"^[ \t]*(?:--[ \t]*|_{5,}[ \t]*)$", re.M)
RULED_SIGNATURE = re.compile(r"<hr\b[^<>]*>\s*<(i|em|small)\b[^<>]*>(?:(?!<hr\b).)*?</\1>\s*\Z", re.I | re.S)
QUOTED_LINE = re.compile(r"^[ \t]*(?:[| \t]*>|(?:\|[ \t]*)+(?!.*\|))")
LINK, MORE = "\ue000", "\ue001"
URL = re.compile(r"(?:https?://|www\.)[^\s<>\[\]\"|]+", re.I)
TOKEN = re.compile(r"\ue000|#\w+|\w+|[^\w\s\ue001]")
WORD = re.compile(r"[^\W_]+")
# A name with a number, such as a marker's, as against a word with digits in place of letters.
CODE_WORD = re.compile(r"[A-Za-z]+\d+")
LETTER_DIGITS = re.compile(r"[0134]+")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _link(address: str) -> str:
    """A link's mark and one more for every further word of its address."""
    return f" {LINK}{MORE * (len(WORD.findall(address)) - 1)} "


def own_text(text: str | None) -> str:
    """The poster's own words, a line a visible line: without quotes in any style, the lines that introduce them, the
    signature (at most SIGNATURE_WORDS words below the last line of dashes with any below it, or slanted below a rule), images and code. Earlier such lines,
    and one above a longer text, part the text and end nothing. A link is LINK, MORE for every further word of its address, and its text. None and
    empty texts have none."""
    if not text:
        return ""
    text = text.replace("\r\n", "\n").replace(LINK, "").replace(MORE, "")
    text = CODE.sub("\n", IMAGE.sub(" ", COMMENT.sub(" ", text)))
    kept, depth, at = [], 0, 0
    for mark in QUOTE.finditer(text):
        if depth == 0:
            kept.append(text[at : mark.start()])
        depth = max(0, depth + (-1 if "/" in mark.group()[:3] else 1))
        at = mark.end()
        kept.append("\n")
    if depth == 0:
        kept.append(text[at:])
    text = "".join(kept)
    ruled = RULED_SIGNATURE.search(text)
    if ruled and WORD.search(OTHER_TAG.sub(" ", text[: ruled.start()])):
        text = text[: ruled.start()]
    text = BREAK.sub("\n", text)
    lines: list[str] = []
    for line in text.split("\n"):
        if QUOTED_LINE.match(line):
            while lines and (lines[-1] == "" or lines[-1].rstrip().endswith(":")):
                last = lines.pop()
                if last:
                    break
            continue
        lines.append(line)
    text = "\n".join(lines)
    ends = [end for end in SIGNATURE.finditer(text) if WORD.search(text, end.end())]
    if ends and WORD.search(text[: ends[-1].start()]) and len(WORD.findall(text[ends[-1].end() :])) <= SIGNATURE_WORDS:
        text = text[: ends[-1].start()]
    text = ANCHOR.sub(lambda m: _link(m.group(1) or m.group(3) or "") + (m.group(2) or m.group(4) or "") + " \n", text)
    text = OTHER_TAG.sub(" ", text)
    return URL.sub(lambda m: _link(m.group()), _visible(html.unescape(text)))


def symbols(text: str) -> list[str]:
    """One symbol a token: a function word's class, another word's shape, a link, a tag or a mark."""
    out = []
    for token in TOKEN.findall(text):
        low = token.lower()
        if token == LINK:
            out.append("U")
        elif token[0] == "#" and len(token) > 1:
            out.append("H")
        elif low in CLASS_OF:
            out.append(CLASS_OF[low])
        elif token.isdigit():
            out.append("0")
        elif token.isalpha():
            out.append("w")
        elif token[0].isalnum():
            out.append("x")
        elif token in ".!?":
            out.append(".")
        else:
            out.append("," if token == "," else "-")
    return out


def _sentences(text: str) -> list[str]:
    return [s for line in text.split("\n") for s in re.split(r"(?<=[.!?])\s+", line.strip()) if s]


def _prose(sentence: str) -> list[str] | None:
    """The sentence's symbols if it reads as prose."""
    if not (sentence[0].isupper() and sentence[-1] in ".!?"):
        return None
    found = symbols(sentence)
    named = sum(s in "DRPKVN" for s in found)
    return found if len(found) >= 6 and named >= 2 and named >= 0.2 * len(found) and not {"U", "H"} & set(found) else None


def prose_model(texts: DataFrame) -> dict[str, int]:
    """Counts of all n-grams up to ORDER symbols in prose sentences, those seen once too, over all texts.

    There are fewer symbols than 16, so the table is bounded whatever the texts; 3,141 n-grams at sf0.1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for sentence in _sentences(text):
                    found = _prose(sentence)
                    if found:
                        chain = "^" * (ORDER - 1) + "".join(found)
                        counts.update([chain[i - ORDER : i] for i in range(ORDER, len(chain) + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    longest = texts.select("own").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    # every symbol ends one longest n-gram, so the shorter ones are counted by their ends
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.substring("gram", F.lit(ORDER + 1) - k, k)))
    table = longest.select(ends.alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in table.toLocalIterator()}


CONTENT = {"w": "w", "0": "w", "x": "w"}


class Scorer:
    """Surprise of symbol sequences, each order backing off to the next shorter by Witten and Bell's rule, and of their
    word classes alone, where words that are not function words are one class."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.after: dict[str, list[int]] = {}
        for gram, n in counts.items():
            kinds = self.after.setdefault(gram[:-1], [0, 0])
            kinds[0] += n
            kinds[1] += 1
        self.seen: dict[str, float] = {}
        self.bits: dict[str, float] = {}
        classes = dict.fromkeys("wDRPKVN", 0.0)
        for s, n in ((CONTENT.get(g, g), n) for g, n in counts.items() if len(g) == 1):
            if s in classes:
                classes[s] += n
        whole = sum(classes.values()) + len(classes)
        self.classes = {s: -float(np.log((n + 1) / whole)) for s, n in classes.items()}
        # halfway between the prose's own mix and content words alone, and as far on the other side
        prose = sum((n + 1) / whole * self.classes[s] for s, n in classes.items())
        self.bare, self.laden = (prose + self.classes["w"]) / 2, prose + (prose - self.classes["w"]) / 2

    def _surprise(self, gram: str) -> float:
        self.bits[gram] = bits = -float(np.log(self.chance(gram)))
        return bits

    def chance(self, gram: str) -> float:
        known = self.seen.get(gram)
        if known is None:
            lower = self.chance(gram[1:]) if len(gram) > 1 else 1 / 32
            total, kinds = self.after.get(gram[:-1], (0, 0))
            known = (self.counts.get(gram, 0) + kinds * lower) / (total + kinds) if total else lower
            self.seen[gram] = known
        return known

    def surprise(self, found: list[str]) -> float:
        """The log perplexity of a sequence of symbols, begun as a sentence is."""
        chain = "^" * (ORDER - 1) + "".join(found)
        known = self.bits.get
        return sum(known(g) or self._surprise(g) for g in (chain[i - ORDER : i] for i in range(ORDER, len(chain) + 1))) / len(found)


def judge(own: str, scorer: Scorer, high: float, low: float) -> tuple[float, float, float, int, int, int] | None:
    """(perplexity, odd, mix, entries, inside, total) of an own text; None without symbols.

    perplexity: of the whole text, its parts being sentences and, within lines, what bars and semicolons part. odd: the
    share of its words in parts whose log perplexity is above `high` or below `low`. mix: the log perplexity of
    the word classes of those parts, order aside and links and tags apart (0 if they are all there is). entries and inside: links, tags and keyword parts in those parts and
    their words; program output, numbers and codes have none. total: all words. A link counts as the words of its address, a
    list number belongs to its entry.
    """
    found = inside = total = strange = length = 0
    surprise = mixed = 0.0
    classes = 0
    for line in own.split("\n"):
        program = "=" in line or "\t" in line or "{" in line or line.count("_") > 3
        bullet = BULLET.match(line)
        extra = 1 if bullet and bullet.group().strip()[0].isdigit() else 0
        if bullet:
            line = line[bullet.end() :]
        total += extra
        for part in re.split(r"(?<=[.!?;])\s+|\|", line):
            marks = symbols(part)
            if not marks:
                continue
            bits = scorer.surprise(marks)
            surprise, length = surprise + bits * len(marks), length + len(marks)
            words, links = WORD.findall(part), marks.count("U")
            size = len(words) + links + part.count(MORE)
            total += size
            if not size or low <= bits <= high:
                continue
            strange += size
            if program:
                continue
            tags = marks.count("H")
            if not links and tags < 2:
                codes = sum(bool(CODE_WORD.fullmatch(w)) and not LETTER_DIGITS.fullmatch(w.lstrip(LETTERS)) for w in words)
                plain = sum(not w.isdigit() for w in words) - codes
                if codes > 0.3 * len(words) or plain < 0.4 * len(words):
                    continue
                parts = sum(1 for p in part.split(",") if WORD.search(p))
                found += parts if parts > 1 else max(1, len(words) // 4)
            else:
                found += max(links, tags)
            known = [c for c in (scorer.classes.get(CONTENT.get(s, s)) for s in marks) if c is not None]
            mixed, classes = mixed + sum(known), classes + len(known)
            inside += size + extra
            extra = 0
    if not length:
        return None
    return float(np.exp(surprise / length)), strange / max(total, 1), mixed / classes if classes else 0.0, found, inside, total


def scored(documents: DataFrame, *, high: float = HIGH, low: float = LOW) -> DataFrame:
    """(doc_id, perplexity, odd, mix, normal, entries, inside, total) for every document with own words, as `judge` gives them.

    normal: whether the mix of word classes in its abnormal parts is that of prose.
    """
    spark = documents.sparkSession

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([own_text(t) for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", "own"])

    own = documents.select("doc_id", "text").mapInArrow(strip, "doc_id bigint, own string").where(F.length(F.trim("own")) > 0)
    own = Scratch(spark, "spam").save(own, "own")
    model = spark.sparkContext.broadcast(prose_model(own))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        names = ["doc_id", "perplexity", "odd", "mix", "normal", "entries", "inside", "total"]
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            judged = ((doc_id, judge(text, scorer, high, low)) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows = [(doc_id, *found[:3], scorer.bare <= found[2] <= scorer.laden, *found[3:]) for doc_id, found in judged if found]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return own.mapInArrow(score, "doc_id bigint, perplexity double, odd double, mix double, normal boolean, entries bigint, inside bigint, total bigint")


def stuffed(documents: DataFrame) -> DataFrame:
    """(doc_id, perplexity, odd, entries, share) of the keyword-stuffed and link-list pages.

    Those with more than SHARE of their own words, and at least ENTRIES entries, in parts of abnormal perplexity whose mix of
    word classes is abnormal too. Null, empty and wholly quoted texts are none.
    """
    share = F.col("inside") / F.greatest(F.col("total"), F.lit(1))
    found = scored(documents).where((F.col("inside") * 3 > F.col("total") * 2) & (F.col("entries") >= ENTRIES) & ~F.col("normal"))
    return found.select("doc_id", "perplexity", "odd", "entries", share.alias("share"))
