"""Derived scalar properties as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 14 standard fonts, and the resolution of colour-space families to components.
STANDARD_FONTS = (
    "Courier", "Courier-Bold", "Courier-BoldOblique", "Courier-Oblique", "Helvetica", "Helvetica-Bold", "Helvetica-BoldOblique", "Helvetica-Oblique", "Symbol", "Times-Bold", "Times-BoldItalic", "Times-Italic", "Times-Roman", "ZapfDingbats",
)
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4}
SIZE_BUCKETS = ((10_240, "tiny"), (1_048_576, "small"), (26_214_400, "medium"), (262_144_000, "large"))


def size_bucket(size: Column) -> Column:
    out = None
    for below, name in SIZE_BUCKETS:
        out = F.when(size < below, name) if out is None else out.when(size < below, name)
    return out.otherwise("huge")


def date_digits(text: Column) -> Column:
    """A date without its ``D:`` prefix, as its first 14 digits."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, "^D:", ""), "[^0-9]", ""), 1, 14)


def dates_match(info: Column, xmp: Column) -> Column:
    """Null without an info date, false without an XMP date, else whether the digits are the same."""
    return F.when(info.isNull(), F.lit(None).cast("boolean")).when(xmp.isNull(), False).otherwise(date_digits(info) == date_digits(xmp))


def without_subset_prefix(name: Column) -> Column:
    """``ABCDEF+Name`` -> ``Name``."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+(?=.)", "")


def is_standard_font(name: Column) -> Column:
    return without_subset_prefix(name).isin(*STANDARD_FONTS)


def is_symbolic(flags: Column, name: Column) -> Column:
    """Bit 3 says symbolic, bit 6 not; else by name, else null."""
    return (
        F.when(flags.bitwiseAND(4) != 0, True)
        .when(flags.bitwiseAND(32) != 0, False)
        .when(without_subset_prefix(name).isin("Symbol", "ZapfDingbats"), True)
        .when(is_standard_font(name), False)
        .otherwise(F.lit(None).cast("boolean"))
    )


def has_private_use(text: Column) -> Column:
    return F.rlike(text, F.lit("[\\uE000-\\uF8FF]"))


def hex_digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9A-Fa-f]"))


def span_length(low: Column, high: Column) -> Column:
    """0 where inverted, null where not finite."""
    finite = ~(F.isnan(low) | F.isnan(high)) & (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
    return F.when(finite, F.greatest(high - low, F.lit(0.0)))


def component_count(n: Column, family: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in COMPONENTS.items():
        out = F.when(family == name, F.lit(value)).otherwise(out)
    return F.coalesce(n, out)


def icc_header(profile: Column) -> Column:
    """Version, class, colour space, connection space, intent and tag count of a profile of at least 132 bytes."""
    text = lambda at: F.rtrim(F.decode(F.substring(profile, at + 1, 4), "ISO-8859-1"))
    number = lambda at, n: F.conv(F.hex(F.substring(profile, at + 1, n)), 16, 10).cast("bigint")
    version = F.concat(number(8, 1).cast("string"), F.lit("."), F.floor(number(9, 1) / 16).cast("string"))
    fields = F.struct(version.alias("version"), text(12).alias("device_class"), text(16).alias("color_space"), text(20).alias("pcs"), number(64, 4).alias("rendering_intent"), number(128, 4).alias("tag_count"))
    return F.when(F.octet_length(profile) >= 132, fields)


def profile_family(flavour: Column) -> Column:
    return F.substring_index(flavour, "-", 1)


def display_name_parts(name: Column) -> Column:
    """``pdfa-2b`` -> family, part, conformance."""
    return F.struct(profile_family(name).alias("family"), F.regexp_extract(name, "^[a-z]+-([0-9]+)", 1).try_cast("int").alias("part"), F.regexp_extract(name, "^[a-z]+-[0-9]+(.*)$", 1).alias("conformance"))


def reason_token(reason: Column, prefix: str, suffix: str) -> Column:
    """The text between the first prefix and the next suffix, null where they aren't there."""
    at = F.instr(reason, F.lit(prefix))
    rest = F.when(at > 0, F.substring(reason, at + len(prefix), F.length(reason)))
    return F.when(F.contains(rest, F.lit(suffix)), F.substring_index(rest, suffix, 1))


# Why a rule can't run.
REASON_CATEGORIES = ("missingLink", "missingObjectType", "missingProperty", "missingSemanticFamily", "unsupportedExpression")


def reason_category(reason: Column) -> Column:
    """The category of a reason's text: the first of an unknown link, property or family that it names, else an expression.

    A reason that is a semantic family's absence by name is that.  Null stays null.
    """
    names = lambda what: F.rlike(reason, F.lit(f"unknown (validation model )?{what}"))
    found = F.when(reason == "missingSemanticFamily", reason).when(names("link"), "missingLink").when(names("property"), "missingProperty").when(names("family"), "missingObjectType")
    return found.otherwise(F.when(reason.isNotNull(), "unsupportedExpression"))


def is_identifier(text: Column) -> Column:
    return F.rlike(text, F.lit("^[A-Za-z0-9._:-]{1,128}$"))


def bounded(text: Column, most_bytes: int) -> Column:
    """The text, null where it is larger."""
    return F.when(F.octet_length(text) <= most_bytes, text)


def location_text(path: Column, number: Column, generation: Column, offset: Column) -> Column:
    """Path, else object key, else offset, else ``unknown``."""
    return F.coalesce(path, F.when(number.isNotNull(), F.concat_ws(" ", F.lit("object"), number.cast("string"), F.coalesce(generation, F.lit(0)).cast("string"))), F.when(offset.isNotNull(), F.concat(F.lit("offset "), offset.cast("string"))), F.lit("unknown"))


def utf8_valid(content: Column) -> Column:
    """Whether bytes are UTF-8; what isn't text (null) is."""
    return F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(True))


def utf16_text(content: Column) -> Column:
    """Text of bytes that begin with a UTF-16 byte order mark; null for an odd number of bytes or a bad surrogate.

    Pairs of surrogates are checked on the hexadecimal digits of the units.
    """
    digits = F.hex(content)
    little = F.substring(digits, 1, 4) == "FFFE"
    marked = little | (F.substring(digits, 1, 4) == "FEFF")
    rest = F.substring(digits, 5, 2**31 - 1)
    units = F.when(little, F.regexp_replace(rest, "(..)(..)", "$2$1")).otherwise(rest)
    paired = F.regexp_replace(F.regexp_replace(units, "(....)", "$1 "), "D[89AB].. D[C-F].. ", "")
    good = (F.octet_length(content) % 2 == 0) & ~F.rlike(paired, F.lit("(^| )D[89A-F].. "))
    return F.when(marked & good, F.decode(F.unhex(units), "UTF-16BE"))


def glyph_evidence(embedded: Column, standard: Column, widths: Column, cid_set: Column) -> Column:
    """A font's glyphs are known if it is embedded, a standard one, has widths or a set of its characters."""
    return F.coalesce(embedded, F.lit(False)) | F.coalesce(standard, F.lit(False)) | F.coalesce(widths > 0, F.lit(False)) | F.coalesce(cid_set, F.lit(False))


def color_space_family(named: Column, keys: Column) -> Column:
    """The family that a colour space's dictionary names, else what its keys tell."""
    has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    told = (
        F.when(has("N"), "ICCBased").when(has("HiVal") | has("Lookup"), "Indexed").when(has("TintTransform") & has("Colorants"), "DeviceN").when(has("TintTransform"), "Separation").otherwise("unknown")
    )
    return F.coalesce(named, told)


def normalized_color_space(value: Column, keys: Column) -> Column:
    """Struct ``family``, ``base``, ``n``, ``target`` of a colour space's text: a name, an array or a dictionary; null for others.

    An array begins with the family's name; its second member is the base or the stream that it refers to.
    """
    name = F.regexp_extract(value, r"^\s*/([^\s/<>\[\]()]+)\s*$", 1)
    head = F.regexp_extract(value, r"^\s*\[\s*/([^\s/<>\[\]()]+)", 1)
    second = F.regexp_extract(value, r"^\s*\[\s*/[^\s/<>\[\]()]+\s*/([^\s/<>\[\]()]+)", 1)
    target = F.regexp_extract(value, r"^\s*\[\s*/[^\s/<>\[\]()]+[^\d\]]*(\d+)\s+\d+\s+R", 1).try_cast("bigint")
    family = F.when(name != "", name).when(head != "", head).when(value.rlike(r"^\s*<<"), color_space_family(F.nullif(F.regexp_extract(value, r"/Family\s*/([^\s/<>\[\]()]+)", 1), F.lit("")), keys))
    n = component_count(F.regexp_extract(value, r"/N\s+(\d+)", 1).try_cast("int"), family)
    return F.when(family.isNotNull(), F.struct(family.alias("family"), F.nullif(second, F.lit("")).alias("base"), n.alias("n"), target.alias("target")))


def media_alt_valid(alt: Column) -> Column:
    """An even number of strings (an array, null for what is no string), every second one not empty; null is not valid."""
    odd = F.filter(alt, lambda x, i: (i % 2 == 1) & (F.length(x) == 0))
    return F.coalesce((F.size(alt) % 2 == 0) & (F.size(F.filter(alt, lambda x: x.isNull())) == 0) & (F.size(odd) == 0), F.lit(False))


def packet_attribute(packet: Column, name: str, most: int = 128) -> Column:
    """A quoted attribute of the processing instruction that opens a metadata packet; null where absent or larger than *most* bytes."""
    head = F.regexp_extract(packet, r"<\?xpacket\s+([^?]*)\?>", 1)
    found = F.regexp_extract(head, rf"(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    value = F.regexp_extract(found, r"=\s*[\"'](.*)[\"']$", 1)
    return F.when(found != "", bounded(value, most))


# Limits of repair output.
MAX_PREFIX_BYTES, MAX_FILE_NAME_BYTES = 64, 255


def repair_output_name(path: Column, prefix: Column) -> Column:
    """The file name of a repaired copy; null where the prefix, the name or their sum is too long, or either is a path of its own."""
    name = F.substring_index(path, "/", -1)
    good = (F.octet_length(prefix) <= MAX_PREFIX_BYTES) & ~F.contains(prefix, F.lit("/")) & (name != "") & (F.octet_length(F.concat(prefix, name)) <= MAX_FILE_NAME_BYTES)
    return F.when(good, F.concat(prefix, name))


# The phase of work that a cluster of unsupported rules belongs to, by what is missing.
PHASE_BY_TYPE = {
    "G3": ("font", "fontDescriptor", "fontProgram", "cMap", "embeddedFontFile"),
    "G4": ("resource", "colorSpace", "iccProfile", "extGState", "pattern", "shading", "function", "xObject", "formXObject", "postScriptXObject", "image", "outputIntent"),
    "G5": ("metadata",),
    "G6": ("accessibilityDocument", "structureTreeRoot", "structureElement", "textChunk", "imageChunk", "accessibilityAnnotation", "artifact", "table", "list", "heading", "link"),
}
METADATA_PROPERTIES = ("XMPTitle", "XMPProducer", "XMPKeywords", "XMPDescription", "XMPCreatorTool", "XMPCreator", "XMPCreatorSize", "doModDatesMatch", "doCreationDatesMatch", "part")
SECTION_BY_PHASE = {"G3": "Resource semantics", "G4": "Resource semantics", "G5": "XMP RDF metadata", "G6": "Accessibility semantics"}


def cluster_phase(reason: Column, object_type: Column, property_: Column, semantic_family: Column) -> Column:
    by_type = F.lit("G2")
    for phase, names in PHASE_BY_TYPE.items():
        by_type = F.when(object_type.isin(*names), phase).otherwise(by_type)
    missing = reason == "missingSemanticFamily"
    return (
        F.when(reason == "unsupportedExpression", "G1")
        .when(missing & (semantic_family == "contentStream"), "G4")
        .when(missing & (semantic_family == "accessibility"), "G6")
        .when((reason == "missingProperty") & (object_type == "document") & property_.isin(*METADATA_PROPERTIES), "G5")
        .otherwise(by_type)
    )


def cluster_section(reason: Column, phase: Column) -> Column:
    """Which part of the design a cluster belongs to."""
    by_phase = F.lit("Derived model properties")
    for name, section in SECTION_BY_PHASE.items():
        by_phase = F.when(phase == name, section).otherwise(by_phase)
    return F.when(reason == "unsupportedExpression", "Expression parity").otherwise(by_phase)


def cluster_release_blocking(family: Column) -> Column:
    return F.coalesce(family.isin("pdfa", "pdfua"), F.lit(False))


def within_caps(limits: dict[str, int], caps: dict[str, int]) -> dict[str, int]:
    """The configured limits over the built-in caps; one that is no positive number, unknown or above its cap is an error."""
    for name, value in limits.items():
        if name not in caps:
            raise ValueError(f"unknown limit {name}")
        if not 0 < value <= caps[name]:
            raise ValueError(f"{name} must be between 1 and {caps[name]}")
    return {**caps, **limits}
