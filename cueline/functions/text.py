"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section openers, sentence ends, marks, noise characters, station names, credit words and song lines.
OPENERS = ("首先", "第一", "第二", "第三", "第四", "第五", "接下来", "然后", "最后", "总结", "下面", "我们来看", "另一个")
SENTENCE_ENDS = "。！？!?；;"
MARKS = "。；！？!?;、：:，,.…“”\"'（）()《》"
EDGE_MARKS = "。！？!?；;，,、：:,.…“”\"'（）()《》|· "
NOISE = "嗯啊唉呃额哦哈"
STATIONS = ("cctv", "bilibili", "bibi", "电视剧")
CREDIT_WORDS = (
    "演员表", "片尾曲", "主题歌", "插曲", "作词", "作曲", "编曲", "演唱", "导演", "编剧", "主演", "领衔主演",
    "配音", "摄影", "摄像", "美术", "剪辑", "录音", "制片", "监制", "出品", "联合出品", "字幕", "鸣谢",
)
SONG_LINES = ("你挑着担我牵着马", "迎来日出送走晚霞", "踏平坎坷成大道", "斗罢艰险又出发", "一番番春秋冬夏", "一场场酸甜苦辣", "敢问路在何方", "路在脚下")

#: Java's \\s with (?U) lacks the four separators that Python counts as white space.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def _class(chars: str, negate: bool = False) -> str:
    return "[" + "^" * negate + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, SPACES, "")


def subtitle_text(text: Column) -> Column:
    """Without white space, and without marks at either end."""
    return F.btrim(squeeze(text), F.lit(EDGE_MARKS))


def sentence_parts(text: Column) -> Column:
    """Runs up to and with one sentence end; further and leading ends vanish."""
    return F.regexp_extract_all(text, F.lit(f"{_class(SENTENCE_ENDS, True)}+{_class(SENTENCE_ENDS)}?"), F.lit(0))


def opens_section(text: Column) -> Column:
    return text.rlike("^(" + "|".join(OPENERS) + ")")


def looks_like_subtitle(text: Column) -> Column:
    t = subtitle_text(text)
    return (F.length(t) >= 2) & ~F.lower(t).rlike("|".join(STATIONS))


def is_mark(char: Column) -> Column:
    return char.rlike(f"^{_class(MARKS)}$")


def _share(text: Column, part: str, of: Column) -> Column:
    return F.when(F.length(of) > 0, F.length(F.regexp_replace(text, part, "")) / F.length(of)).otherwise(0.0)


def noise_share(text: Column) -> Column:
    """Share of hesitation characters among all that are not white space; 0 for none."""
    t = squeeze(text)
    return _share(t, _class(NOISE, True), t)


def han_share(text: Column) -> Column:
    """Share of Han characters (U+4E00 to U+9FFF) among all that are neither white space nor marks; 0 for none."""
    t = F.regexp_replace(squeeze(text), _class(MARKS), "")
    return _share(t, "[^\\x{4e00}-\\x{9fff}]", t)


def repeated_runs(text: Column) -> Column:
    """Runs of four or more equal characters."""
    return F.regexp_count(text, F.lit(r"([^\n])\1{3,}"))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def hamming(a: Column, b: Column) -> Column:
    """Places at which two texts of one length differ; null for different lengths."""
    differ = F.aggregate(F.zip_with(characters(a), characters(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(F.length(a) == F.length(b), differ)


def edge_noise(longer: Column, shorter: Column) -> Column:
    """Whether the longer text is the shorter one with an ASCII letter or digit more at one end."""
    first, last, n = F.left(longer, F.lit(1)), F.right(longer, F.lit(1)), F.length(longer)
    one = "^[0-9A-Za-z]$"
    front = first.rlike(one) & (F.substr(longer, F.lit(2)) == shorter)
    back = last.rlike(one) & (F.left(longer, n - 1) == shorter)
    return (n == F.length(shorter) + 1) & (front | back)


def stable_text(a: Column, b: Column) -> Column:
    """The text that two readings of one subtitle share: equal, one character apart (the first), or with noise at an edge (the shorter); else null."""
    return (
        F.when(a == b, a)
        .when((F.length(a) == F.length(b)) & (hamming(a, b) <= 1), a)
        .when(edge_noise(a, b), b)
        .when(edge_noise(b, a), a)
    )


def short_han_substitution(a: Column, b: Column) -> Column:
    n, han = F.length(a), "^[\\x{4e00}-\\x{9fff}]*$"
    return F.coalesce((n == F.length(b)) & (n < 4) & a.rlike(han) & b.rlike(han) & (hamming(a, b) == 1), F.lit(False))


def reading_jitter(a: Column, b: Column) -> Column:
    """Long texts that differ in several places, but few."""
    n = F.length(a)
    return F.coalesce((n == F.length(b)) & (n >= 8) & (hamming(a, b) > 1) & (hamming(a, b) <= F.greatest(F.lit(2), F.floor(n / 8))), F.lit(False))


def credit_signal(text: Column, words: tuple[str, ...] = CREDIT_WORDS, lines: tuple[str, ...] = SONG_LINES) -> Column:
    """2 if a credit word occurs, 1 for each song line, 1 for a short text with 啦."""
    t = subtitle_text(text)
    hit = F.lit(0)
    for w in words:
        hit = F.when(t.contains(w), 2).otherwise(hit)
    songs = sum((t.contains(s).cast("int") for s in lines), F.lit(0))
    return hit + songs + (t.contains("啦") & (F.length(t) <= 6)).cast("int")


def has_song_line(text: Column, lines: tuple[str, ...] = SONG_LINES) -> Column:
    t = subtitle_text(text)
    return sum((t.contains(s).cast("int") for s in lines), F.lit(0)) > 0


def preview(text: Column, limit: int = 80) -> Column:
    """White space runs as one space, cut to ``limit`` characters."""
    t = F.btrim(F.regexp_replace(text, SPACES, " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit("..."))).otherwise(t)


def job_name(text: Column) -> Column:
    """A name fit for folders."""
    t = F.regexp_replace(F.regexp_replace(text, r'(?U)[<>:"/\\|?*\s\x1c-\x1f]+', "_"), "_+", "_")
    t = F.btrim(t, F.lit("._- "))
    return F.when(t == "", "default").otherwise(t)


def json_object(content: Column) -> Column:
    """The JSON object (as text) in a reply: of a fenced block, the whole reply, or, of a reply that is no JSON, from the first brace to the last; null if none parses to an object."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    parsed = lambda c: F.try_parse_json(c)
    is_object = lambda c: F.coalesce(F.schema_of_variant(parsed(c)).startswith("OBJECT"), F.lit(False))
    fenced, whole, braces = F.nullif(fenced, F.lit("")), F.btrim(content, F.lit(" \t\r\n")), F.nullif(braces, F.lit(""))
    return F.when(is_object(fenced), fenced).when(is_object(whole), whole).when(parsed(whole).isNull() & is_object(braces), braces)


def rate(text: Column) -> Column:
    """A number or a fraction n/d; null for junk and zero denominators."""
    parts = F.split(text, "/")
    whole = F.expr("try_cast(NULL AS DOUBLE)")
    n, d = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 1, n).when((F.size(parts) == 2) & (d != 0), n / d).otherwise(whole)


def corner_points(box: Column) -> Column:
    """[x1, y1, x2, y2] as four corner points."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)).cast("double") for i in range(4))
    return F.when(F.size(box) == 4, F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))).otherwise(F.expr("CAST(array() AS ARRAY<ARRAY<DOUBLE>>)"))


def signature_distance(a: Column, b: Column) -> Column:
    """Bits that differ between two signatures (arrays of longs); null if either is null or lengths differ."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.when(F.size(a) == F.size(b), bits)
