"""Text, code, time and media expressions; all built-in unless a Python decoder is the only way (Arrow batches then)."""

from __future__ import annotations

import html
import re
from email.header import decode_header

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def nth(line: Column, n: int) -> Column:
    """The n-th blank-separated column, negative from the end; null where there is none."""
    return F.try_element_at(F.split(F.trim(line), r"\s+"), F.lit(n + 1 if n >= 0 else n))


def stem(name: Column) -> Column:
    """The name without its last extension, in lower case; leading dots belong to the stem."""
    return F.lower(F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def numeric_token(t: Column) -> Column:
    """The broad rule: s...e, anything with an x, or digits with dots."""
    return (t.startswith("s") & t.contains("e")) | t.contains("x") | t.rlike(r"^[0-9]+(\.[0-9]+)*$")


def weighted_dice(a: Column, b: Column, numeric: float = 2.0) -> Column:
    """2 * shared weight / total weight of two token lists, with counts; numeric tokens weigh more."""
    weight = lambda t: F.when(numeric_token(t), F.lit(numeric)).otherwise(F.lit(1.0))
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, t: s + weight(t))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, t: s + weight(t) * F.least(count(a, t), count(b, t)))
    whole = total(a) + total(b)
    return F.when(whole > 0, 2 * shared / whole).otherwise(F.lit(0.0))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a fold of the usual table, a row at a time."""
    zeros = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        cell = lambda acc, j: F.array_append(acc, F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, -1))))
        return F.when(F.size(b) == 0, prev).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), F.array(F.lit(0)), cell))

    return F.element_at(F.aggregate(a, zeros, row), -1)


def name_score(a: Column, b: Column) -> Column:
    """0.6 weighted Dice + 0.4 common-subsequence ratio."""
    n = F.size(a) + F.size(b)
    return 0.6 * weighted_dice(a, b) + 0.4 * F.when(n > 0, 2.0 * lcs(a, b) / n).otherwise(F.lit(0.0))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def without_colours(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")


def without_point_zero(text: Column) -> Column:
    return F.regexp_replace(text, r"\.0$", "")


def attribute(page: Column, name: str) -> Column:
    """All values of an attribute, in either kind of quotes, whatever its case."""
    return F.regexp_extract_all(page, F.lit(rf"(?i){name}\s*=\s*(['\"])(.*?)\1"), F.lit(2))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _decoder(fn):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run


html_unescaped = _decoder(html.unescape)
unicode_unescaped = _decoder(lambda t: re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t))
hex_unescaped = _decoder(lambda t: re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), t))
mime_decoded = _decoder(lambda t: "".join(p.decode(c or "ascii", "replace") if isinstance(p, bytes) else p for p, c in decode_header(t)))


def url_decoded(text: Column) -> Column:
    """%XX decoded; a plus sign stays, and so does a percent sign without two digits."""
    return F.try_url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25"))


def hex_of(n: Column) -> Column:
    return F.hex(n)


def from_hex(text: Column) -> Column:
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, -10).cast("long")


def data_uri(mime: str, content: Column) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), r"\r\n", ""))


def shortened(text: Column, width: int) -> Column:
    """Cut on the left, behind an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.lit("..."), F.right(text, F.lit(width - 3)))).otherwise(text)


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def compact_minutes(minutes: Column) -> Column:
    """Minutes as h:mm, d or w, whichever is short."""
    m = minutes.cast("long")
    return F.when(m < 1440, F.format_string("%d:%02d", F.floor(m / 60).cast("long"), m % 60)).when(m < 10080, F.format_string("%dd", F.floor(m / 1440).cast("long"))).otherwise(F.format_string("%dw", F.floor(m / 10080).cast("long")))


def real_seconds(text: Column) -> Column:
    """Whole seconds of NmS.SSs."""
    return F.regexp_extract(text, r"(\d+)m(\d+)", 1).cast("int") * 60 + F.regexp_extract(text, r"(\d+)m(\d+)", 2).cast("int")


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss-yyyy/MM/dd")


def scaled(value: Column) -> Column:
    """A number with a k, M or G unit."""
    step = lambda d, u: F.concat(F.floor(value / d).cast("long").cast("string"), F.lit(u))
    return F.when(value >= 1 << 30, step(1 << 30, "G")).when(value >= 1 << 20, step(1 << 20, "M")).when(value >= 1 << 10, step(1 << 10, "k")).otherwise(F.floor(value).cast("long").cast("string"))


def bits_per_pixel(size: Column, seconds: Column, audio_bps: Column, w: Column, h: Column, fps: Column) -> Column:
    """(8 size - seconds * audio) / (w h fps seconds); -1 where it isn't defined."""
    pixels = w * h * fps * seconds
    return F.when(pixels > 0, (8 * size - seconds * F.coalesce(audio_bps, F.lit(0.0))) / pixels).otherwise(F.lit(-1.0))


def target_kbps(w: Column, h: Column, fps: Column, bpp: float = 0.06) -> Column:
    return F.floor(F.lit(bpp) * w * h * fps / 1000).cast("long")


def address(line: Column) -> Column:
    """Kind, host and port of an allow-list line: v4 with an optional port, a CIDR block, [v6]:port, host:port; else null."""
    t = F.trim(line)
    v4 = r"^(\d{1,3}(?:\.\d{1,3}){3})"
    kind = F.when(t.rlike(v4 + r"/\d{1,2}$"), "cidr").when(t.rlike(v4 + r"(:\d+)?$"), "v4").when(t.rlike(r"^\[[0-9a-fA-F:]+\]:\d+$"), "v6").when(t.rlike(r"^[A-Za-z0-9.-]+:\d+$"), "host")
    host = F.when(kind == "cidr", t).when(kind == "v4", F.regexp_extract(t, v4, 1)).when(kind == "v6", F.regexp_extract(t, r"^\[(.*)\]", 1)).when(kind == "host", F.regexp_extract(t, r"^(.*):", 1))
    number = F.regexp_extract(t, r":(\d+)$", 1).try_cast("int")
    return F.struct(kind.alias("kind"), host.alias("host"), F.when((kind != "cidr") & number.between(1, 65535), number).alias("port"))


def version_key(version: Column) -> Column:
    """A key that orders dotted versions by their numbers; a part that is no number counts as 0."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(0)))


def globbed(text: Column, pattern: str) -> Column:
    """Whether the whole text fits a pattern in which * stands for anything."""
    return text.like("%".join(p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for p in pattern.split("*")))


def byte_diffs(a: Column, b: Column) -> Column:
    """Where two blobs differ, as "OFFSET AA BB" lines in hex; offsets start at 1, and the longer end is not compared."""
    x, y = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(x), F.octet_length(y))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(x, i, 1) != F.substring(y, i, 1))
    line = lambda i: F.concat_ws(" ", F.lpad(F.hex(i), 8, "0"), F.hex(F.substring(x, i, 1)), F.hex(F.substring(y, i, 1)))
    return F.when(n > 0, F.transform(places, line)).otherwise(F.array().cast("array<string>"))


def top_store(path: Column) -> Column:
    """The owning folder of a nested repository path: everything from the first worktrees or modules part on goes."""
    return F.regexp_replace(path, "/(worktrees|modules)/.*$", "")


def _sorted_xml(text: str) -> str:
    """Elements by name and attributes, attributes by name, one an indented line; blank text goes. Broken documents are null."""
    from xml.etree import ElementTree
    from xml.sax.saxutils import escape, quoteattr

    def own(e) -> str:
        return "".join(t for t in [e.text, *[c.tail for c in e]] if t and t.strip())

    def lines(e, deep: int) -> list[str]:
        pad = "   " * deep
        head = f"{pad}<{' '.join([e.tag, *[f'{k}={quoteattr(v)}' for k, v in sorted(e.items())]])}>{escape(own(e))}"
        if not len(e):
            return [f"{head}</{e.tag}>"]
        inner = [line for c in sorted(e, key=lambda c: (c.tag, sorted(c.items()))) for line in lines(c, deep + 1)]
        return [head, *inner, f"{pad}</{e.tag}>"]

    try:
        return "\n".join(lines(ElementTree.fromstring(text), 0))
    except ElementTree.ParseError:
        return None


sorted_xml = _decoder(_sorted_xml)


def wrapped(text: Column, width: int = 80) -> Column:
    """Words filled greedily into lines. A word takes one place more, but for the first one of a later line; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(s: Column, w: Column) -> Column:
        fits = s["n"] + F.length(w) + 1 <= width
        joined = F.concat(s["out"], F.when(~fits, F.lit("\n")).when(s["n"] == 0, F.lit("")).otherwise(F.lit(" ")), w)
        return F.struct(joined.alias("out"), F.when(fits, s["n"] + F.length(w) + 1).otherwise(F.length(w)).alias("n"))

    return F.aggregate(words, start, put, lambda s: s["out"])


def speaker_parts(text: Column, mark: str = ">>") -> Column:
    """What each speaker says, behind the mark; what comes before the first mark stands without it, blank parts go."""
    parts = F.transform(F.split(text, mark), lambda p, i: F.struct(F.trim(p).alias("t"), i.alias("i")))
    return F.transform(F.filter(parts, lambda p: p["t"] != ""), lambda p: F.when(p["i"] > 0, F.concat(F.lit(f"{mark} "), p["t"])).otherwise(p["t"]))


def clipped(name: Column) -> Column:
    """A file name up to its first dot."""
    return F.substring_index(name, ".", 1)


def nul_separated(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\x00"))


def locale_time(line: Column, zone_mark: str) -> Column:
    """The time in a "Mon 02 Jan 2023 03:04:05 PM ZONE" line that has the mark; null in other lines."""
    stamp = F.regexp_extract(line, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2} [AP]M)", 1)
    return F.when(line.contains(zone_mark), F.try_to_timestamp(stamp, F.lit("d MMM yyyy hh:mm:ss a")))


def minute_key(stamp: Column) -> Column:
    """HH:MM of a caption's time."""
    return F.left(stamp, F.lit(5))


def field_range(line: Column) -> Column:
    """The two hexadecimal ends of a "start-stop ..." line."""
    pick = lambda k: F.regexp_extract(line, r"^([0-9a-fA-F]+)-([0-9a-fA-F]+)\b", k)
    return F.struct(F.nullif(pick(1), F.lit("")).alias("start"), F.nullif(pick(2), F.lit("")).alias("stop"))


def disk_result(line: Column) -> Column:
    """Bandwidth and operations a second, as written, of a disk benchmark's result line; null where it has none."""
    pick = lambda name: F.nullif(F.regexp_extract(line, rf"(?:{name.upper()}|{name.lower()})=([^,)\s]*)", 1), F.lit(""))
    return F.struct(pick("bw").alias("bandwidth"), pick("iops").alias("iops"))


def ideal_bitrate(w: Column, h: Column, fps: Column) -> Column:
    return w * h * fps * 0.05


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    """Infinite where no time passed, 0 without tokens."""
    return F.when(tokens <= 0, F.lit(0.0)).when(seconds > 0, tokens / seconds).otherwise(F.lit(float("inf")))


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())])))
def json_leaves(docs: pd.Series) -> pd.Series:
    """(path, value) of every scalar at any depth: names joined by dots, places in brackets. Null and false leaves are left out; what is no JSON has none."""
    import json

    def leaves(text):
        try:
            todo = [("", json.loads(text, parse_int=str, parse_float=str))]
        except (TypeError, ValueError):
            return []
        out = []
        while todo:
            path, v = todo.pop()
            join = f"{path}." if path else ""
            if isinstance(v, dict):
                todo += [(f"{join}{k}", x) for k, x in reversed(v.items())]
            elif isinstance(v, list):
                todo += [(f"{join}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
            elif v is not None and v is not False:
                out.append({"path": path, "value": "true" if v is True else v})
        return out

    return docs.map(leaves)


#: The eight terminal colours, plain and bright.
COLOURS = ("#000000", "#aa0000", "#00aa00", "#aa5500", "#0000aa", "#aa00aa", "#00aaaa", "#aaaaaa")
BRIGHT = ("#555555", "#ff5555", "#55ff55", "#ffff55", "#5555ff", "#ff55ff", "#55ffff", "#ffffff")


def _palette(n: int) -> str:
    """Colour n of 256: 16 of the terminal, a cube of six steps a side, 24 greys."""
    if n < 16:
        return (COLOURS + BRIGHT)[n]
    if n > 231:
        return "#" + f"{(n - 232) * 10 + 8:02x}" * 3
    return "#" + "".join(f"{(v * 40 + 55) * (v > 0):02x}" for v in ((n - 16) // 36, (n - 16) // 6 % 6, (n - 16) % 6))


def _styled(state: dict[str, str], codes: list[int]) -> dict[str, str]:
    state, at = dict(state), 0
    while at < len(codes):
        c = codes[at]
        name = "background-color" if c in range(40, 50) or c in range(100, 108) else "color"
        if c == 0:
            state = {}
        elif c in (1, 3, 4):
            k, v = {1: ("font-weight", "bold"), 3: ("font-style", "italic"), 4: ("text-decoration", "underline")}[c]
            state[k] = v
        elif c in (22, 23, 24):
            state.pop({22: "font-weight", 23: "font-style", 24: "text-decoration"}[c], None)
        elif c in (39, 49):
            state.pop(name, None)
        elif c in (38, 48) and codes[at + 1 : at + 2] == [5] and len(codes) > at + 2:
            state[name] = _palette(codes[at + 2] % 256)
            at += 2
        elif c in (38, 48) and codes[at + 1 : at + 2] == [2] and len(codes) > at + 4:
            state[name] = "#" + "".join(f"{x % 256:02x}" for x in codes[at + 2 : at + 5])
            at += 4
        elif 30 <= c <= 37 or 40 <= c <= 47:
            state[name] = COLOURS[c % 10]
        elif 90 <= c <= 97 or 100 <= c <= 107:
            state[name] = BRIGHT[c % 10]
        at += 1
    return state


def _ansi_html(text: str) -> str:
    out, state, at = [], {}, 0
    text = re.sub("\x1b\\][^\x07\x1b]*(?:\x07|\x1b\\\\)", "", text)  # titles and links
    pieces = re.split("\x1b\\[([0-9;?]*)([A-Za-z])", text)
    for at in range(0, len(pieces), 3):
        if at and pieces[at - 1] == "m":
            state = _styled(state, [int(c or 0) for c in pieces[at - 2].split(";")] if "?" not in pieces[at - 2] else [])
        if pieces[at]:
            style = ";".join(f"{k}:{v}" for k, v in sorted(state.items()))
            body = html.escape(pieces[at])
            out.append(f'<span style="{style}">{body}</span>' if style else body)
    return "".join(out)


#: Terminal output as HTML: colours and styles become spans, other control sequences go. Cursor movements are not followed.
ansi_html = _decoder(_ansi_html)


def _laid_out(text: str) -> str:
    ends: dict[int, int] = {}  # where each < that is closed is closed
    commas: dict[int, int] = {}  # of those directly inside it
    open_: list[int] = []
    for at, c in enumerate(text):
        if c == "<":
            open_.append(at)
        elif c == ">" and open_:
            ends[open_.pop()] = at
        elif c == "," and open_:
            commas[open_[-1]] = commas.get(open_[-1], 0) + 1
    out, closing, at = [], [], 0  # closing: ends of the templates that are laid out around this place
    while at < len(text):
        line = "\n" + " " * (2 * len(closing))
        if at in ends and not commas.get(at):
            out.append(text[at : ends[at] + 1])
            at = ends[at]
        elif at in ends:
            out.append(f"<{line}  ")
            closing.append(ends[at])
        elif closing and at == closing[-1]:
            closing.pop()
            out.append(line[:-2] + ">")
        elif text[at] == ",":
            out.append(f",{line}")
            at += text[at + 1 : at + 2] == " "
        else:
            out.append(text[at])
        at += 1
    return "".join(out)


#: Template types over several lines, two blanks a level; a template of one argument stays on its line.
laid_out = _decoder(_laid_out)


def visible(text: Column, width: int) -> Column:
    """The first so many visible characters of a line; colours do not count and go."""
    return F.left(without_colours(text), F.lit(width))
