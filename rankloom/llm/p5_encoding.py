"""Problem 5: text that was decoded with a wrong character encoding.

Characters are mapped back to the bytes from which a legacy decoder made them. An automaton over the byte
structure of the true encoding (UTF-8, or the double bytes of GBK) finds the maximal well-formed multibyte
spans, and only those spans are decoded. A span counts if what it decodes to is plausible: letters and
punctuation of living scripts, and for Han text common characters in place of rare ones. The steps are
repeated for text that was garbled more than once. Replacement characters inside words mark text that is
garbled for good.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Single-byte encodings that UTF-8 or GBK is mistaken for, the most usual first.
SINGLE_BYTE = ["cp1252", "mac_roman", "cp1251", "cp850", "cp437", "cp1254", "cp1250", "koi8_r", "iso8859_15"]
#: Double-byte encodings that UTF-8 (or GBK) is mistaken for.
DOUBLE_BYTE = ["gbk", "big5hkscs"]
#: Words by which a line shows that it quotes garbled characters.
ABOUT_ENCODINGS = re.compile(r"utf-?8|latin-?1|iso-?8859|windows-?125\d|cp125\d|\bgbk\b|gb18030|\bbig5\b|charset|encod|decod|mojibake|replacement char|byte order|乱码|编码|解码|字符集|caract[eè]re de rempl|codage|zeichensatz|zeichenkodierung|kodier|codificaci|juego de caracteres", re.I)
ROUNDS = 3


def _cls(chars) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(chars))) + "]"


class Legacy:
    """The characters that a single-byte decoder made of the bytes 0x80 to 0xff, and the automaton over them."""

    def __init__(self, codec: str):
        of = {}
        for b in range(0x80, 0x100):
            try:
                of[b] = bytes([b]).decode(codec)
            except UnicodeDecodeError:
                of[b] = chr(b)
        self.byte = {c: b for b, c in of.items()}
        if codec.startswith("cp125") or codec == "iso8859_15":  # C1 controls stand for themselves
            for b in range(0x80, 0xA0):
                self.byte.setdefault(chr(b), b)
        at = {b: [c for c, x in self.byte.items() if x == b] for b in range(0x80, 0x100)}
        span = lambda a, z: [c for b in range(a, z + 1) for c in at[b]]
        self.lead, self.next = span(0xC2, 0xF4), span(0x80, 0xBF)
        cont = _cls(self.next)
        self.utf8 = re.compile(
            f"(?:{_cls(span(0xC2, 0xDF))}{cont}|{_cls(span(0xE0, 0xE0))}{_cls(span(0xA0, 0xBF))}{cont}|{_cls(span(0xE1, 0xEC) + span(0xEE, 0xEF))}{cont}{{2}}"
            f"|{_cls(span(0xF0, 0xF0))}{_cls(span(0x90, 0xBF))}{cont}{{2}}|{_cls(span(0xF1, 0xF3))}{cont}{{3}})+"
        )
        self.gbk = re.compile(f"(?:{_cls(span(0xA1, 0xA3) + span(0xB0, 0xF7))}{_cls(span(0xA1, 0xFE))}){{2,}}")

    def data(self, span: str) -> bytes:
        return bytes(self.byte[c] for c in span)


_C1 = re.compile("[\x80-\x9f]")
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")


@functools.cache
def _legacy() -> dict[str, Legacy]:
    return {c: Legacy(c) for c in SINGLE_BYTE}


@functools.cache
def common_han() -> frozenset[str]:
    """The Han characters of the first level of GB 2312, which nearly all modern text is made of."""
    return frozenset(c for row in range(0xB0, 0xD8) for col in range(0xA1, 0xFF) if (c := bytes([row, col]).decode("gb2312", "ignore")))


def _is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿"


def plausible(text: str) -> bool:
    """True if the decoded text holds only letters and signs that people write, in the amount they write them."""
    other, han, common = 0, 0, 0
    if _C1.search(text):  # text garbled twice, of which one layer is off: what is left of it must be spans again
        text = _legacy()["cp1252"].utf8.sub("", text)
    for c in text:
        o = ord(c)
        if o < 0x80 and c.isprintable():
            continue
        if 0xA0 <= o <= 0x17F or 0x2010 <= o <= 0x203A or o in (0x20AC, 0x2122, 0x2116, 0x2212, 0x218, 0x219, 0x21A, 0x21B) or 0x2190 <= o <= 0x21FF or 0x3000 <= o <= 0x303F or 0xFF01 <= o <= 0xFF5E or 0x1F300 <= o <= 0x1FAFF or 0xFE0F == o:
            continue
        if _is_han(c):
            han += 1
            common += c in common_han()
        elif 0x391 <= o <= 0x3C9 or 0x401 <= o <= 0x451 or 0x3041 <= o <= 0x30FF or 0xAC00 <= o <= 0xD7A3:
            other += 1
        else:
            return False
    if other and other < 3:
        return False
    return not han or common >= 0.6 * han


def _single(line: str) -> tuple[str, int]:
    """The line with the spans of the best single-byte reading decoded, and the number of characters covered.

    Each reading is a pair of the encoding mistakenly used and the true one; the one that explains most
    characters wins, the more usual one among equals.
    """
    best = line, 0
    for true in ("utf-8", "gbk"):
        for legacy in _legacy().values():
            covered = 0

            def put(m: re.Match) -> str:
                nonlocal covered
                text = legacy.data(m[0]).decode(true, "replace")  # noqa: B023
                if true == "gbk":  # noqa: B023
                    han = [c for c in text if _is_han(c)]
                    fits = len(han) >= 2 and sum(c in common_han() for c in han) >= 0.9 * len(han) and "\ufffd" not in text
                else:
                    fits = plausible(text)
                covered += len(m[0]) * fits
                return text if fits else m[0]

            new = (legacy.utf8 if true == "utf-8" else legacy.gbk).sub(put, line)
            if covered > best[1]:
                best = new, covered
    return best


_RUN = re.compile("[^\x00-\x7f]+")


def _double_bytes(run: str, codec: str) -> bytes:
    """Bytes of a run by a double-byte encoding, with its private area by rule; 0xff where there are none."""
    out = bytearray()
    for c in run:
        o = ord(c)
        if codec == "gbk" and 0xE000 <= o <= 0xE765:
            if o < 0xE234:
                out += bytes([0xAA + (o - 0xE000) // 94, 0xA1 + (o - 0xE000) % 94])
            elif o < 0xE4C6:
                out += bytes([0xF8 + (o - 0xE234) // 94, 0xA1 + (o - 0xE234) % 94])
            else:
                col = (o - 0xE4C6) % 96
                out += bytes([0xA1 + (o - 0xE4C6) // 96, 0x40 + col + (col >= 63)])
        elif codec == "gbk" and c == "€":
            out += b"\x80"
        else:
            try:
                out += c.encode(codec)
            except UnicodeEncodeError:
                out += b"\xff"
    return bytes(out)


def _common_share(text: str) -> float:
    shown = [c for c in text if ord(c) > 0x7F and c not in "，。、：；？！（）“”‘’…—·《》【】\ufffd"]
    return sum(c in common_han() for c in shown) / len(shown) if shown else 1.0


def _double(line: str) -> tuple[str, int]:
    """As ``_single``, for text that a double-byte decoder made. Each run of non-ASCII characters must decode as a whole or nearly so."""
    covered = 0
    latin: list[str] = []

    def put(m: re.Match) -> str:
        nonlocal covered
        run = m[0]
        data = _double_bytes(run, "gbk")
        spans = [s for s in UTF8.finditer(data) if plausible(s[0].decode("utf-8", "replace"))]
        n = sum(len(s[0]) for s in spans)
        if n and n + sum(b < 0x80 for b in data) >= (0.6 if len(run) > 3 else 1) * len(data.rstrip(b"\xff")):
            decoded = "".join(s[0].decode() for s in spans)
            with_han = any(map(_is_han, decoded))
            if not with_han or _common_share(decoded) > _common_share(run) or len(decoded) < len(run):
                covered += len(run)
                if not with_han:
                    latin.append(run)
                text, at = [], 0
                for s in spans:
                    text += [data[at : s.start()].decode("gbk", "replace"), s[0].decode()]
                    at = s.end()
                return "".join(text) + data[at:].decode("gbk", "replace")
        if len(run) >= 2 and _common_share(run) < 0.7:
            data = _double_bytes(run, "big5hkscs").rstrip(b"\xff")
            if b"\xff" not in data:
                text = data.decode("gbk", "replace")
                if _common_share(text) >= max(0.85, _common_share(run) + 0.3) and sum(map(_is_han, text)) >= 2:
                    covered += len(run)
                    return text
        return run

    new = _RUN.sub(put, line)
    # a lone character among Chinese text that could be an accented letter is what it seems
    if latin and sum(map(len, latin)) == covered and sum(map(_is_han, line)) > sum(_is_han(c) for r in latin for c in r):
        return line, 0
    return new, covered


def _from_c1(m: re.Match) -> str:
    return bytes([ord(m[0])]).decode("cp1252", "ignore") or m[0]


def _suspect() -> re.Pattern:
    lead = [c for x in _legacy().values() for c in x.lead]
    after = [c for x in _legacy().values() for c in x.next]
    latin = []
    for row in range(0xC2, 0xC6):  # GBK characters whose bytes are those of one accented letter or sign
        for col in range(0x80, 0xC0):
            latin += bytes([row, col]).decode("gbk", "ignore")
    rare = [chr(o) for o in range(0x4E00, 0xA000) if not chr(o).encode("gb2312", "ignore")]
    han = "㐀-鿿"
    return re.compile(f"{_cls(lead)}{_cls(after)}|[\x80-\x9f�-]|(?<![{han}]){_cls(latin)}+(?![{han}])|[぀-ㄯ─-▟︰-﹯]|{_cls(rare)}|{_cls(_legacy()['cp1252'].byte)}{{4}}")


@functools.cache
def suspect() -> re.Pattern:
    """A cheap test that every garbled value passes."""
    return _suspect()


def _replacement_sign(line: str) -> str | None:
    """The garbled form of a replacement character in the line, which no one quotes by itself."""
    for legacy in _legacy().values():
        for m in legacy.utf8.finditer(line):
            text = legacy.data(m[0]).decode("utf-8", "replace")
            if text == "\ufffd" or text != m[0] and _legacy()["cp1252"].utf8.fullmatch(text) and _legacy()["cp1252"].data(text).decode("utf-8", "replace") == "\ufffd":
                return m[0]
    return None


def repair_line(line: str) -> tuple[str, bool]:
    """(line with what can be restored, whether it was garbled)."""
    if not suspect().search(line):
        return line, False
    about = bool(ABOUT_ENCODINGS.search(line))
    if about and (sign := _replacement_sign(line)):
        return line.replace(sign, "\ufffd"), True
    text, garbled, isolated = line, False, True
    for _ in range(ROUNDS):
        new, covered = _single(text)
        if not covered:
            new, covered = _double(text)
        if not covered or new == text:
            break
        if garbled and about and isolated:  # a quotation that was garbled itself: its own layer stays
            return text, True
        isolated = isolated and not garbled and _isolated(text, new)
        text, garbled = new, True
    if _C1.search(text):
        text, garbled, isolated = _C1.sub(_from_c1, text), True, False
    lost = "\ufffd" in line
    if about and isolated and not _inside_words(line):
        return line, False
    if not garbled and lost:
        return text, True
    return text, garbled


_INSIDE = re.compile(r"[^\W\d_]�|�[^\W\d_]|��")


def _inside_words(line: str) -> bool:
    return bool(_INSIDE.search(line))


def _isolated(old: str, new: str) -> bool:
    """True if the words that changed consist of nothing but the garbled characters, as in a quotation."""
    changed = set(re.findall(r"\S+", old)) - set(re.findall(r"\S+", new))
    return all(not re.search(r"[A-Za-z]", w) for w in changed)


def repair(value: str | None) -> tuple[str | None, bool]:
    """(value with what can be restored, whether a line of it was garbled); null and '' stay."""
    if not value or value.isascii() or not suspect().search(value):
        return value, False
    lines = [repair_line(x) for x in value.split("\n")]
    return "\n".join(x[0] for x in lines), any(x[1] for x in lines)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, titles, plains = (c.to_pylist() for c in batch.columns)
        rows = []
        for i, *values in zip(ids, titles, plains, strict=True):
            for field, value in zip(("title", "plain"), values, strict=True):
                new, garbled = repair(value)
                if garbled:
                    rows.append((i, field, value, new, new != value and "�" not in new))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:4]), pa.array(cols[4], pa.bool_())], ["extract_id", "field", "garbled", "restored", "whole"])


def repaired(extractions: DataFrame) -> DataFrame:
    """``extract_id``, ``field`` ('plain' or 'title'), ``garbled``, ``restored``, ``whole`` of each garbled value.

    ``restored`` has every span decoded that can be; ``whole`` is false where nothing could be restored or
    lost characters remain. Null and empty values, and values without a garbled line, give no row; repeated
    rows give one each. Whole values are read, however long. No shuffle.
    """
    # a value of ASCII only never reaches Python
    seen = lambda c: F.when(F.col(c).rlike(r"[^\x00-\x7f]"), F.col(c)).alias(c)
    rows = extractions.select("extract_id", seen("title"), seen("plain")).where("title is not null or plain is not null")
    return rows.mapInArrow(_run, "extract_id bigint, field string, garbled string, restored string, whole boolean")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/extractions.parquet")).select("extract_id", "field")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/extractions.parquet"))
