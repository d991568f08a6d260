"""Bit fields, codes and names as column expressions: integers in, hex text or bit counts out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = {"png": "89504E470D0A1A0A", "jpeg0": "FFD8FFE0", "jpeg1": "FFD8FFE1", "gif87": "474946383761", "gif89": "474946383961"}
UNDEFINED_LANGUAGE = 0x55C4


def fields(*parts: tuple[Column | int, int]) -> tuple[Column, int]:
    """One whole number of (value, width) fields, the first one highest, and its width (up to 63 bits)."""
    value, width = F.lit(0).cast("long"), 0
    for v, n in parts:
        value, width = value * (1 << n) + (v if isinstance(v, Column) else F.lit(v)).cast("long"), width + n
    return value, width


def hexed(value: Column, width: int) -> Column:
    """Hex text of a field group, filled up with zero bits to whole bytes."""
    pad = -width % 8
    return F.lpad(F.hex(value * (1 << pad)), (width + pad) // 4, "0")


def adts_header(mpeg2: Column, rate_index: Column, channels: Column, frame_bytes: Column, fullness: Column) -> Column:
    return hexed(*fields((0xFFF, 12), (mpeg2, 1), (0, 2), (1, 1), (1, 2), (rate_index, 4), (0, 1), (channels, 3), (0, 4), (frame_bytes, 13), (fullness, 11), (0, 2)))


def audio_config(rate_index: Column, channels: Column) -> Column:
    return hexed(*fields((2, 5), (rate_index, 4), (channels, 4)))


def sbr_audio_config(core_index: Column, full_index: Column, channels: Column) -> Column:
    """The core's config with the SBR extension; mono adds that parametric stereo is absent."""
    first = ((2, 5), (core_index, 4), (channels, 4), (0, 3), (0x2B7, 11), (5, 5), (1, 1), (full_index, 4))
    return F.when(channels == 1, hexed(*fields(*first, (0x548, 11), (0, 1)))).otherwise(hexed(*fields(*first)))


def descriptor(tag: int, size: Column) -> Column:
    """Tag and size in four bytes of seven bits, all but the last with the high bit set."""
    seven = lambda k: F.shiftright(size, 7 * k) % 128
    return hexed(*fields((tag, 8), (seven(3) + 128, 8), (seven(2) + 128, 8), (seven(1) + 128, 8), (seven(0), 8)))


def language_code(name: Column) -> Column:
    """Three letters in five bits each; anything else is undefined."""
    low = F.lower(F.substring(name, 1, 3))
    letter = lambda k: F.ascii(F.substring(low, k, 1)) - 96
    return F.when(low.rlike("^[a-z]{3}$"), letter(1) * 1024 + letter(2) * 32 + letter(3)).otherwise(UNDEFINED_LANGUAGE)


def is_mp4(name: Column) -> Column:
    """Whether an output of that name is a container; a stream is for ``-``, .aac and .adts."""
    return F.coalesce(~((name == "-") | F.lower(name).rlike(r"\.(aac|adts)$")), F.lit(True))


def output_name(name: Column, mp4: Column) -> Column:
    """The name with its extension, if any after the last separator, replaced."""
    return F.concat(F.regexp_replace(name, r"\.[^./\\]*$", ""), F.when(mp4, ".m4a").otherwise(".aac"))


def is_image(content: Column) -> Column:
    found = F.lit(False)
    for magic in MAGIC.values():
        found = found | F.startswith(F.hex(content), F.lit(magic))
    return found


def gapless_tag(priming: Column, padding: Column, samples: Column) -> Column:
    word = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.concat(F.lit(" 00000000 "), word(priming, 8), F.lit(" "), word(padding, 8), F.lit(" "), word(samples, 16), F.lit(" 00000000" * 8))


def rate_or_quality(text: Column, is_rate: Column) -> tuple[Column, Column]:
    """Bit rate and quality from text: leading digits, or the default of 128 kbit/s or 100."""
    value = F.coalesce(F.try_to_number(F.regexp_extract(text, r"^\s*\+?([0-9]{1,9})", 1), F.lit("999999999")).cast("long"), F.lit(0))
    return F.when(is_rate, F.when(value > 0, value * 1000).otherwise(128_000)).otherwise(0), F.when(is_rate, 0).otherwise(F.when(value > 0, F.least(value, F.lit(65535))).otherwise(100))


def leading_zeros(x: Column) -> Column:
    """Zero bits before the highest one of a number of 32 bits without sign; 32 of 0."""
    return F.when(x == 0, 32).otherwise(32 - F.length(F.bin(x.cast("long"))))


def window_info(sequence: Column, max_band: Column, groups: Column) -> tuple[Column, Column]:
    """The fields of a channel's window as hex text, and their number: its sequence (2 is short) and its bands, for short
    windows with the lengths of their groups as a field of seven bits, for others without a predictor."""
    head = [(0, 1), (sequence, 2), (0, 1)]
    short, other = fields(*head, (max_band, 4), (grouping_bits(groups), 7)), fields(*head, (max_band, 6), (0, 1))
    return F.when(sequence == 2, hexed(*short)).otherwise(hexed(*other)), F.when(sequence == 2, short[1]).otherwise(other[1])


def pair_head(tag: Column, sequence: Column, max_band: Column, ms: Column, n_bands: int) -> tuple[Column, Column]:
    """The fields before a channel pair's data, with a window that both share, as hex text, and their number: the
    element's kind and tag, the window's kind and its bands, and the mask of bands coded as middle and side, only if there
    is such a band. ms: an array of booleans by band; long blocks."""
    used = F.exists(ms, lambda m: m)
    shared = [(1, 3), (tag, 4), (1, 1), (0, 1), (sequence, 2), (0, 1), (max_band, 6), (0, 1)]
    mask = F.aggregate(F.slice(ms, 1, n_bands), F.lit(0).cast("long"), lambda s, m: s * 2 + F.when(m, 1).otherwise(0))
    with_mask, without = fields(*shared, (1, 2), (mask, n_bands)), fields(*shared, (0, 2))
    return F.when(used, hexed(*with_mask)).otherwise(hexed(*without)), F.when(used, with_mask[1]).otherwise(without[1])


def escape_code(x: Column) -> tuple[Column, Column]:
    """Code and length of a magnitude of 16 or more: ones, a zero, then the bits after its highest one."""
    high = F.floor(F.log2(x + F.lit(0.5))).cast("int")
    prefix = F.pow(F.lit(2.0), high - 3).cast("long") - 2
    base = F.pow(F.lit(2.0), high).cast("long")
    return prefix * base + x - base, 2 * high - 3


def section_bits(run: Column, short: bool = False) -> Column:
    """Bits of a section of ``run`` bands: the book, and a run field for each full field and one more."""
    most, bits = (7, 3) if short else (31, 5)
    return 4 + bits * (F.floor(run / most) + 1)


def grouping_bits(groups: Column) -> Column:
    """For each short window but the first, 1 if it belongs to the group of the window before."""
    ones = lambda n: F.when(n > 1, F.repeat(F.lit("1"), n - 1)).otherwise("")
    return F.conv(F.array_join(F.transform(groups, ones), "0"), 2, 10).cast("int")


def fill_left(bits: Column) -> Column:
    """What fill elements leave of a number of bits; negative if the last one takes a few more. Each has 7 bits and up
    to 14 bytes, or 15 bits and 14 to 269 bytes; a step takes one off, so few steps are enough for any frame."""

    def step(left: Column, _: Column) -> Column:
        few = F.floor((left - 3) / 8)
        many = F.least(F.floor((left - 7) / 8), F.lit(269))
        return F.when(left < 7, left).when(few < 15, left - 7 - 8 * few).otherwise(left - 15 - 8 * many).cast("long")

    return F.aggregate(F.sequence(F.lit(0), (bits / 2167).cast("int") + 2), bits.cast("long"), step)


#: A character in UTF-8's outer form, as Latin-1 text of its bytes: overlong forms and surrogates pass.
OUTER_FORM = r"[\x01-\x7F]+|[\xC0-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF7][\x80-\xBF]{3}"


def utf8_text(content: Column) -> tuple[Column, Column]:
    """Whether bytes, up to the first zero byte, are well-formed in outline, and their text: as UTF-8 if they are
    (what has no character becomes U+FFFD), else each byte as the Latin-1 character of its number. Null stays null and
    counts as well-formed."""
    raw = F.substring_index(F.decode(content, "ISO-8859-1"), "\u0000", 1)
    valid = F.coalesce(F.regexp_replace(raw, OUTER_FORM, "") == "", F.lit(True))
    return valid, F.when(valid, F.make_valid_utf8(F.encode(raw, "ISO-8859-1").cast("string"))).otherwise(raw)
