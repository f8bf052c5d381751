"""Sentence boundaries across languages and scripts.

Method: document-centred disambiguation. Whether a token before a stop is an abbreviation,
and whether the capitalised word after it is a proper name, is decided by unambiguous
occurrences elsewhere in the same document; where the document has none, by the counts of
the whole corpus; where that has none either, by lists of known abbreviations. Terminators
are rules by script.

A document is cut at every place that may end a sentence. A place that its own text
decides is settled there; of another one, what it depends on (the token, the word after
it, and what each answer would mean) goes as a short text to a join with the corpus counts,
and the pieces around a place that ends no sentence are put together again. So no text is
shuffled, no count is left out however rare its token, and nothing is collected.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folioscope.sources.tables import checkpoint

# Abbreviations by what may follow them.
TITLES = frozenset("dr drs prof profs mr mrs ms messrs st hr fr mm mme mmes mlle sr sra srta dra dña проф акад доц κ κα δρ डॉ श्री د أ gen col capt lt rev hon pres gov sen rep".split())
LABELS = frozenset("no nos nr fig figs eq eqs sec secs sect tab tabs ch chap vol pp p art ref refs abb abs kap bd éq pág págs núm nº рис табл стр гл σχ πίν σελ αρ κεφ ص app appx suppl item ex".split())
NEVER_LAST = frozenset("e.g i.e cf vs viz approx resp n.b z.b d.h bzw vgl ca sog u.a evtl inkl p.ex c.-à-d p.ej т.е см напр βλ δηλ π.χ ee esp incl excl est i.d.r m.e s.o s.u o.ä".split())
MAY_BE_LAST = frozenset("etc al usw u.s u.k u.n e.u ee.uu uu a.m p.m jr ph.d m.d b.a m.a m.sc b.sc inc ltd co corp г гг тыс млн млрд руб т.д т.п др пр н.э κ.λπ κ.ά b.c a.d u.s.a d.c и.т.д и.др".split())
MONTHS_DE = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
BEFORE_ORDINAL_DE = frozenset("im am vom zum beim der die das den dem des ab seit bis jeden jeder jedem zur".split())
#: Of these the ones that are words of other languages too, and words that show a text to be German.
AMBIGUOUS_DE, SHOWS_DE = frozenset("am die das den des ab".split()), frozenset("und der ist nicht ein eine einer mit auf für von wird werden sich zur im vom zum beim".split())
JA_AFTER_QUOTE = ("と", "という", "って", "は", "が", "を", "に", "の", "も", "で", "、", "など", "だ", "です")
ZH_REPORTING = regex.compile(r"[^。！？；\s]{0,12}?(?:问|問|说|說|道|写|寫|答|称|稱|表示|指出|认为|認為|解释|補充|补充|强调|喊|叫)[^。！？]{0,6}[。！？，：,]")
TH_JOINS_NEXT = ("เช่น", "ได้แก่", "อย่างไรก็ตาม", "นอกจากนี้", "ดังนั้น", "ทั้งนี้", "กล่าวคือ", "โดยเฉพาะ", "คือ", "ว่า", "และ", "หรือ", "แต่", "ของ", "ที่", "ใน")
TH_JOINS_BEFORE = ("และ", "หรือ", "แต่", "ซึ่ง", "ที่", "เช่น", "โดย", "เพราะ", "เนื่องจาก", "เพื่อ", "จึง", "ว่า")
#: Verbs and what stands before verbs: a stretch that starts with one has its subject before it.
TH_VERBS = ("มี", "เป็น", "คือ", "อยู่", "ได้", "ถูก", "จะ", "ไม่", "ต้อง", "ควร", "อาจ", "ยัง", "ก็", "ทำ", "ให้", "เคย", "กำลัง", "สามารถ")
TH_OPENS_LIST = ("ได้แก่", "ดังนี้", "ประกอบด้วย")

PAIRS = {"(": ")", "[": "]", "“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›"}
OPENERS = set(PAIRS) | {"„", '"', "'", "‘", "¿", "¡", "‚"}
CLOSERS = set(PAIRS.values()) | {'"', "'", "’", "“"}

_BLANK = regex.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+|[ \f]+")
_LINE = regex.compile(r"\r\n|\r|\n| ")
_ITEM = regex.compile(r"[^\S\r\n]*(?:[-–—*•·▪◦‣]\s+|\(?(?:\p{N}{1,3}|\p{Ll}|[ivxIVX]{1,5})\)\s+|(?:\p{N}{1,3})\.\s+)(?=\S)")
_BULLET = regex.compile(r"[^\S\r\n]*[-–—*•·▪◦‣]\s")
_STOP = regex.compile(r"[.!?…。！？؟।॥؛;。｡]+")
_SPACED = regex.compile(r"(?<![\p{L}\p{M}.])\p{L}\p{M}*\.\s$")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_THAI = regex.compile(r"[฀-๿]")
_GREEK = regex.compile(r"[Ͱ-Ͽἀ-῿]")
#: A word or a dotted token, with the stop that ends no sentence or the space before a small letter behind it; the form of both the document's and the corpus's evidence.
OCCURRENCE = r"[\p{L}\p{M}]+(?:[.’'-][\p{L}\p{M}]+)*+(?:\.(?=,|\s+\p{Ll})|\s(?=\p{Ll}))?"
_OCCURRENCE = regex.compile(OCCURRENCE)
_NAME = regex.compile(r"(?<=\p{Ll}\s)\p{Lu}[\p{L}\p{M}]*")

#: A piece of a text up to a place that may end a sentence, and what that depends on: '' if it ends one, else "token, tab, word, tab, answer if the token is an abbreviation, answer if nothing is known of it"; answers are y, n, or c: if the word is no name.
PIECES = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("joint", StringType())]))


class Evidence:
    """What a document says about tokens by their unambiguous occurrences in it; letters count as they are written, large or small."""

    def __init__(self, text: str):
        self.cased = regex.search(r"\p{Lu}", text) is not None
        self.text = text
        self._seen: tuple[set[str], set[str], set[str]] | None = None
        self._names: set[str] | None = None

    def _occurrences(self) -> tuple[set[str], set[str], set[str]]:
        if self._seen is None:
            abbreviated, plain, small = set(), set(), set()
            for found in set(_OCCURRENCE.findall(self.text)):
                if found[-1] == ".":
                    abbreviated.add(found[:-1])
                elif found[-1].isspace():
                    plain.add(found[:-1])
                if found[0].islower():
                    small.add(found.rstrip(". \t\r\n"))
            self._seen = abbreviated, plain, small
        return self._seen

    def token(self, token: str) -> str | None:
        """'abbreviation' if it stands with a stop before a small letter or a comma, 'word' if it stands before a small letter without one; None if neither or both."""
        abbreviated, plain, _ = self._occurrences()
        if (token in abbreviated) == (token in plain):
            return None
        return "abbreviation" if token in abbreviated else "word"

    def before_digit(self, token: str) -> bool:
        """True if the document writes the token before a figure without a stop."""
        return regex.search(rf"(?<![\p{{L}}\p{{M}}.]){regex.escape(token)}\s?\p{{N}}", self.text) is not None

    def common_word(self, word: str) -> bool | None:
        """True if the word stands small elsewhere, False if it stands large after a small word; None if neither."""
        if word.lower() in self._occurrences()[2]:
            return True
        if self._names is None:
            self._names = set(_NAME.findall(self.text))
        return False if word in self._names else None


def _regions(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost quoted or bracketed spans [opening mark, after closing mark) of text[start:end]; what is never closed is none."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for i in range(start, end):
        c = text[i]
        if stack and c == stack[-1][0]:
            _, a = stack.pop()
            found.append((a, i + 1))
        elif c == '"':
            if any(x == '"' for x, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                _, a = stack.pop()
                found.append((a, i + 1))
            elif text.find('"', i + 1, end) >= 0:
                stack.append(('"', i))
        elif c in PAIRS:
            stack.append((PAIRS[c], i))
        elif c == "„":
            closing = min((k for k in (text.find("“", i, end), text.find("”", i, end)) if k > 0), default=-1)
            if closing > 0:
                stack.append((text[closing], i))
        elif c in ")]”»」』）" and any(x == c for x, _ in stack):
            while stack[-1][0] != c:
                stack.pop()
            _, a = stack.pop()
            found.append((a, i + 1))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return outer


def _token_before(text: str, at: int, lead: int) -> str:
    """The letters, stops, apostrophes and hyphens right before text[at], from a letter on, with a single letter and stop before a space in front ("z. B")."""
    i = at
    while i > lead and (text[i - 1] in ".’'-" or text[i - 1].isalpha() or regex.match(r"\p{M}", text[i - 1])):
        i -= 1
    while i < at and not text[i].isalpha():
        i += 1
    if i == at:
        return ""
    spaced = _SPACED.search(text, max(lead, i - 4), i)
    return text[spaced.start() if spaced else i : at]


def _word_before(text: str, at: int, lead: int, same) -> int:
    """Where the run of characters that are `same`, right before text[at], starts."""
    while at > lead and same(text[at - 1]):
        at -= 1
    return at


@lru_cache(maxsize=1 << 14)
def _listed(form: str, nxt: str) -> str | None:
    """What the lists say of a stop after a lower-case token, before a character: y, n, or None if the token is on none."""
    if form in NEVER_LAST or form in TITLES:
        return "n"
    if form in LABELS and (nxt.isdigit() or form not in ("no", "item", "art", "ex", "app") and nxt in "("):
        return "n"
    if form in MAY_BE_LAST:
        if nxt.isdigit() or nxt in "([" and form != "etc":
            return "y" if nxt.isdigit() and form in ("etc", "u.s", "a.m", "p.m", "uu", "ee.uu") else "n"
        return "y"
    return None


def _stop_after_token(text: str, at: int, nxt: str, following: str, facts: Evidence, lead: int) -> bool | str:
    """Whether the single full stop at text[at] ends a sentence, given the character and the word that follow; or what that depends on (see PIECES)."""
    found = _token_before(text, at, lead)
    if not found:
        digits = _word_before(text, at, lead, str.isnumeric)
        if 0 < at - digits <= 2 and following and (digits == lead or text[digits - 1].isspace()):  # an ordinal
            if following.lower() in MONTHS_DE:
                return False
            gap = _word_before(text, digits, lead, str.isspace)
            before = text[_word_before(text, gap, lead, str.isalpha) : gap].lower()
            if before in BEFORE_ORDINAL_DE and nxt.isupper():
                return before in AMBIGUOUS_DE and not any(facts.common_word(w) for w in SHOWS_DE if w != before)
        return True
    token = "".join(found.split()).strip("'’-")
    low = token.lower()
    last = low.rpartition(".")[2]
    one_letter = len(last) == 1 and not regex.match(r"[一-鿿぀-ヿ]", last)
    listed = _listed(low, nxt)
    if listed is None and low != found.lower():
        listed = _listed(last, nxt)
    if low == "г" and listed == "y":
        listed = "y" if text[_word_before(text, at - 1, lead, str.isspace) - 1 : at - 1].strip()[:1].isdigit() else "n"
    # the document's own use comes before any list; of single letters it tells nothing, as they are words and initials alike
    own = None if one_letter and len(low) == 1 else facts.token(token)
    if own == "word" and listed == "n" and nxt.isdigit() and not facts.before_digit(token):
        own = None
    if own == "word":
        return True
    common = facts.common_word(following) if following and nxt.isupper() else False if not following else facts.common_word(following)
    by_word = "c" if common is None else "y" if common else "n"
    if listed is not None:
        if_abbreviation = if_unknown = listed
    elif one_letter:
        if len(low) == 1:
            return False  # an initial
        return by_word == "y" if by_word != "c" else f"\t{following.lower()}\tcc"
    else:
        if_abbreviation, if_unknown = by_word, "y"
    answer = if_abbreviation if own else f"{if_abbreviation}{if_unknown}"
    if set(answer) <= {"y"} and not (listed and not own):
        return True
    if own and answer in "yn":
        return answer == "y"
    if nxt.isdigit() and answer == "nn":
        return False  # a label's number: counts of the plain word say nothing about it
    return f"{'' if own else token}\t{following.lower() if 'c' in answer else ''}\t{answer if len(answer) == 2 else answer * 2}"


def _thai_breaks(text: str, start: int, end: int) -> list[int]:
    """Ends of sentences at spaces between Thai words: a space that neither joins a list, a number or a clause."""
    out, in_list = [], False
    words = [(m.start(), m.end()) for m in regex.finditer(r"\S+", text, pos=start, endpos=end)]
    example = False
    for (a, b), (c, d) in zip(words, words[1:]):
        left, right = text[a:b], text[c:d]
        example, follows_example = left == "เช่น", example
        if not _THAI.search(left):
            continue
        opened = in_list
        if left.endswith(TH_OPENS_LIST):
            in_list = True
            continue
        if opened:
            in_list = not left.startswith(("และ", "หรือ"))
            if in_list:
                continue
        if not _THAI.match(left[-1]) or left in TH_JOINS_NEXT:
            continue
        if not _THAI.match(right):
            # digits and single foreign words belong to the clause; two or more of them in a row are a sentence of another language
            if regex.match(r"[\"“«(]?\p{Lu}", right) and regex.match(r"\S+\s+[\p{Latin}\d(\"“]+", text[c:end]):
                out.append(b)
                in_list = False
            continue
        if right.startswith(TH_JOINS_BEFORE):
            continue
        if follows_example and right.startswith(TH_VERBS):
            continue  # an example put between a subject and its verb
        out.append(b)
    return out


def _stretch(text: str, start: int, end: int, facts: Evidence) -> list[tuple[int, int, str]]:
    """Pieces of text[start:end], which holds no blank line and no list item."""
    regions = _regions(text, start, end)
    opened = [a for a, _ in regions]
    breaks = sorted(b for b in (_thai_breaks(text, start, end) if _THAI.search(text, start, end) else ()))
    unit = start
    cuts: list[int] = []
    joints: dict[int, str] = {}

    def region(k: int) -> tuple[int, int] | None:
        i = bisect_right(opened, k - 1) - 1
        return regions[i] if i >= 0 and regions[i][0] < k < regions[i][1] else None

    def unit_start(k: int) -> int:
        i = bisect_right(breaks, k)
        at = max([start, *(b for b in cuts[-1:] if b <= k), *breaks[max(0, i - 1) : i]])
        while at < end and text[at].isspace():
            at += 1
        return at

    for m in _STOP.finditer(text, start, end):
        mark, at, e = m[0], m.start(), m.end()
        if cuts and at < cuts[-1]:
            continue
        if set(mark) <= {";", "؛"}:
            if mark[0] == "؛" or not _GREEK.search(text, max(start, at - 2), at):
                continue
        closed = None
        inside = region(at)
        if inside:
            # only the stop before the closing mark can end the sentence around it
            if text[e : inside[1]].strip(" \xa0 " + "".join(CLOSERS)):
                continue
            e, closed = inside[1], inside
        while e < end and text[e] in CLOSERS and text[e] not in "“":
            e += 1
        wide = mark[-1] in "。！？。｡" or mark[-1] in "।॥؟"
        k = e
        while k < end and text[k].isspace():
            k += 1
        if k >= end:
            cuts.append(e)
            continue
        spaced, nxt = k > e, text[k]
        j = k
        while j < end and (text[j] in OPENERS or text[j].isspace()):
            j += 1
        first = text[j] if j < end else ""
        word = _WORD.match(text, j, end)
        following = word[0] if word else ""
        if mark[0] == "…" and set(mark) <= {"…"} and not spaced:
            continue
        if wide:
            if closed and not spaced and mark[-1] in "。！？｡":
                if closed[0] > unit_start(closed[0]):
                    continue
                rest = text[e:end]
                if text[closed[0]] in "「『":
                    if rest.startswith(JA_AFTER_QUOTE) and not rest.startswith(("など、",)):
                        continue
                elif ZH_REPORTING.match(rest):
                    continue
            elif spaced and first.islower() and closed:
                continue
            cuts.append(e)
            continue
        if nxt in ",;:)]" or (not spaced and not first):
            continue
        if not spaced:
            # a missing space: a word of three small letters or more, the stop, and a capitalised word
            glued = regex.search(r"(?:\p{Ll}{3}|[)\]”\"»\d%])$", text[max(start, at - 3) : at]) and (regex.match(r"\p{Lu}(?:\p{Ll}|[\s'’])", text[j : j + 2]) or nxt in "¿¡“«「" or regex.match(r"[\p{Lo}]", nxt))
            if not glued or regex.search(r"https?:|www\.|@", text[_word_before(text, at, start, lambda c: not c.isspace()) : at]):
                continue
            if mark == "." and regex.search(r"\p{N}$", text[at - 1 : at]) and not regex.match(r"\p{Lu}\p{Ll}", text[j : j + 2]):
                continue
            cuts.append(e)
            continue
        if first.islower() and facts.cased:
            continue
        joint: bool | str = True
        if first.islower() and not facts.cased and mark == ".":
            joint = _stop_after_token(text, at, first, "", facts, start)
        if mark == "." and not closed and not first.islower():
            joint = _stop_after_token(text, at, nxt, following, facts, unit_start(at))
        if not joint:
            continue
        if nxt in "-–—" and regex.match(r"[-–—]\s*\p{Ll}", text[k : k + 3]):
            continue
        cuts.append(e)
        if isinstance(joint, str):
            joints[e] = joint
    spans = []
    for cut in sorted({*cuts, *(b for b in breaks if not region(b)), end}):
        a, b = unit, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            spans.append((a, b, joints.get(cut, "")))
        unit = cut
    if spans:
        spans[-1] = (*spans[-1][:2], "")
    return spans


def _stretches(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """Parts of one paragraph in order: list items, and what stands between them."""
    lines, at = [], start
    for m in _LINE.finditer(text, start, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    marked = [bool(_ITEM.match(text, a, b)) for a, b in lines]
    bullet = [bool(_BULLET.match(text, a, b)) for a, b in lines]
    out: list[tuple[int, int, bool]] = []
    for i, (a, b) in enumerate(lines):
        # inside running text a number and a stop at the start of a line may be there by wrapping
        before = lines[i - 1] if i else None
        settled = before is None or marked[i - 1] or i + 1 < len(lines) and marked[i + 1] or text[before[0] : before[1]].rstrip()[-1:] in ".:;!?。：；！？।" or bullet[i] and text[before[0] : before[1]].rstrip()[-1:] not in ","
        if marked[i] and settled:
            out.append((a, b, True))
        elif out and not out[-1][2]:
            out[-1] = (out[-1][0], b, False)
        else:
            out.append((a, b, False))
    return out


def sentence_pieces(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, joint) of the pieces of a text, in order, without outer white space; see PIECES. Null and blank texts have none."""
    if text is None or not text.strip():
        return []
    facts = Evidence(text)
    pieces, at = [], 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            for a, b, item in _stretches(text, at, end):
                if item:
                    while a < b and text[a].isspace():
                        a += 1
                    while b > a and text[b - 1].isspace():
                        b -= 1
                    if b > a:
                        pieces.append((a, b, ""))
                else:
                    pieces += _stretch(text, a, b, facts)
        at = m.end() if m else end
    return pieces


def sentence_spans(text: str | None, abbreviations: frozenset[str] = frozenset(), common: frozenset[str] = frozenset(), words: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Half-open spans of the sentences of a text, given what a corpus says: its abbreviations, its words that are no names, and its words that no stop belongs to."""
    spans: list[tuple[int, int]] = []
    joined = False
    for a, b, joint in sentence_pieces(text):
        spans.append((spans.pop()[0] if joined else a, b))
        joined = False
        if joint:
            token, word, answers = joint.split("\t")
            answer = answers[0] if token in abbreviations else "y" if token in words else answers[1]
            joined = answer == "n" or answer == "c" and word not in common
    return spans


@F.pandas_udf(PIECES)
def _pieces(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"a": a, "b": b, "joint": j} for a, b, j in sentence_pieces(t)] for t in texts])


def corpus_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(token, abbreviated, plain, n) over all rows: how often each token, as it is written, stands before a stop that ends no sentence, before a small letter without a stop, and in all."""
    raw = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(OCCURRENCE), F.lit(0))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    end = F.right("raw", F.lit(1))
    token = F.regexp_replace("raw", r"[.\s]$", "")
    return raw.groupBy(token.alias("token")).agg(F.sum(F.when(end == ".", F.col("n")).otherwise(0)).alias("abbreviated"), F.sum(F.when(end.rlike(r"\s"), F.col("n")).otherwise(0)).alias("plain"), F.sum("n").alias("n"))


def corpus_evidence(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, abbreviation) of the tokens that the corpus decides, and (word) in lower case of those that are no proper names."""
    tokens = counts.select("token", F.when(F.col("abbreviated") > 2 * F.col("plain"), True).when(F.col("plain") > 2 * F.col("abbreviated"), False).alias("abbreviation")).filter("abbreviation is not null")
    low = F.lower("token")
    small = F.sum(F.when(F.col("token") == low, F.col("n")).otherwise(0))
    # a word that also starts sentences is written large there; a name is hardly ever written small
    words = counts.groupBy(low.alias("word")).agg(small.alias("small"), F.sum("n").alias("n")).filter("small > 0 and 5 * small >= n").select("word")
    return tokens, words


def open_joints(joints: DataFrame, counts: DataFrame) -> DataFrame:
    """Those of df(joint) that end no sentence, as the corpus counts tell."""
    tokens, words = corpus_evidence(counts)
    part = F.split("joint", "\t")
    asked = joints.select("joint", part[0].alias("token"), part[1].alias("word"), part[2].alias("answers"))
    known = asked.join(tokens, "token", "left").withColumn("answer", F.when(F.col("abbreviation"), F.left("answers", F.lit(1))).when(~F.col("abbreviation"), F.lit("y")).otherwise(F.right("answers", F.lit(1))))
    names = known.filter("answer = 'c'").join(words, "word", "left_anti").select("joint")
    return known.filter("answer = 'n'").select("joint").unionByName(names)


def sentence_units(texts: DataFrame, column: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """The columns of df without the text, and unit_start and unit_end of each of its sentences, one row each.

    Offsets are in code points, from 0, half-open. Null and blank texts give no row; rows
    with equal texts give the same units each. Columns named unit_start or unit_end are
    replaced. An empty df gives no row. counts are the corpus counts; those of df if not given.
    """
    counts = checkpoint(corpus_counts(texts, column) if counts is None else counts)  # read twice
    kept = [F.col(f"`{c}`") for c in texts.columns if c not in (column, "unit_start", "unit_end")]
    cut = texts.filter(F.col(column).isNotNull()).select(*kept, _pieces(F.col(column)).alias("__pieces"))
    needs = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("__pieces", lambda p: p.joint), lambda j: j != ""))), "\n")
    cut = checkpoint(cut.withColumn("__needs", needs).withColumn("__key", F.md5("__needs")))  # read twice, and dear to make
    sure, unsure = cut.filter("__needs = ''"), cut.filter("__needs != ''")
    # documents that depend on the same things are one row here, however many they are
    asked = unsure.select("__key", "__needs").distinct().select("__key", F.explode(F.split("__needs", "\n")).alias("joint"))
    held = asked.join(open_joints(asked.select("joint").distinct(), counts), "joint").groupBy("__key").agg(F.collect_set("joint").alias("__held"))
    none = F.array().cast("array<string>")
    whole = sure.select(*kept, "__pieces", none.alias("__held")).unionByName(unsure.join(held, "__key", "left").select(*kept, "__pieces", F.coalesce("__held", none).alias("__held")))
    ends = lambda p: (p.joint == "") | ~F.array_contains("__held", p.joint)
    starts = F.transform(F.filter("__pieces", lambda p, i: (i == 0) | ends(F.get("__pieces", i - 1))), lambda p: p.a)
    stops = F.transform(F.filter("__pieces", ends), lambda p: p.b)
    return whole.select(*kept, F.inline(F.arrays_zip(starts.alias("unit_start"), stops.alias("unit_end"))))
