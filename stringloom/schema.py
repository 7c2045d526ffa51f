"""Kinds, encodings, tags, options and the schemas of the tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Names in the results.
STATIC = ("static_ascii", "static_utf16_le", "static_utf8", "static_utf16_be")
KINDS = (*STATIC, "base64", "go", "rust", "stack", "tight", "decoded")
ENCODINGS = ("ascii", "utf16_le", "utf16_be", "utf8")
TAGS = ("url", "ip_address", "email", "path", "registry", "library", "code", "duplicate", "base64")
FORMATS = ("auto", "pe", "elf", "mach_o", "sc32", "sc64", "sc32_arm", "sc64_arm64")
#: The place of a kind in the order of results: by these names.
ORDER = ("base64", "decoded", "go", "rust", "stack", "static_ascii", "static_utf16_be", "static_utf16_le", "static_utf8", "tight")
#: Groups that a selection can name.
GROUPS = {"static": STATIC, "base64": ("base64",), "lang": ("go", "rust"), "stack": ("stack",), "tight": ("tight",), "decoded": ("decoded",)}
#: The pass that finds a kind; rows of one input are extracted in this order.
PASS = {"static_ascii": 0, "static_utf8": 1, "static_utf16_le": 2, "static_utf16_be": 3, "go": 4, "rust": 4, "decoded": 5, "stack": 6, "tight": 7, "base64": 8}

SECTION = "struct<idx:int,name:string,file_offset:long,file_size:long,virtual_address:long,executable:boolean,writable:boolean>"
IMPORT = "struct<library:string,name:string,iat_va:long>"
PARSED = (
    "input_id string, arch_idx int, format string, arch string, bits int, size long, entry long, scan_start long, scan_end long, "
    f"sections array<{SECTION}>, imports array<{IMPORT}>, symbols map<long,string>, warnings array<string>, error string"
)
#: A string in an input: `address` and `section` are those of its place, `xrefs` is how often code
#: takes its address, `quality` its score where that is wanted, `again` whether
#: its value came before in the same row. `nth` is 0 for the first, in the order of results, of its value, kind and encoding in the row, 1 for
#: the first of these that is in code, or not in code, as that one is not, 2 for all others.
RUN = "struct<kind:string,encoding:string,offset:long,length:long,value:string,align:int,decoded_offset:long,source_length:long,address:long,section:string,in_code:boolean,xrefs:int,quality:double,again:boolean,nth:int>"
#: Bytes that code writes to the stack.
WRITES = "array<struct<place:long,region:long,target:long,bytes:binary>>"


@dataclass(frozen=True)
class Bounds:
    """What one input may cost; None is no bound. Where a bound acts, a warning of the input says so."""

    base64_token: int | None = 1 << 20  # bytes of a Base64 token
    base64_total: int | None = 16 << 20  # bytes that are decoded from an input
    name: int | None = 1024  # bytes of a name in a table of names
    names: int | None = 200_000  # names of a table
    stamp: int | None = 256  # bytes of metadata that are searched for the compiler's version
    crates: int | None = 8192  # and for crate names


@dataclass(frozen=True)
class Options:
    """What to extract. `enabled` None means all kinds; `required_tags` implies annotation, `min_quality` scores."""

    min_length: int = 4
    enabled: tuple[str, ...] | None = None
    format: str = "auto"
    dedupe: bool = False
    skip_code_sections: bool = False
    skip_library_strings: bool = False
    min_quality: float = 0.0
    score_quality: bool = False
    decode_base64: bool = False
    annotate: bool = False
    required_tags: tuple[str, ...] = ()
    min_trigram_score: float | None = None
    bounds: Bounds = Bounds()

    def __post_init__(self):
        if not (math.isfinite(self.min_quality) and 0 <= self.min_quality <= 1):
            raise ValueError("min_quality must be within 0 and 1")
        if self.min_trigram_score is not None and not math.isfinite(self.min_trigram_score):
            raise ValueError("min_trigram_score must be finite")
        if self.min_length < 0 or self.format not in FORMATS:
            raise ValueError("min_length or format out of range")
        for given, known in ((self.enabled or (), KINDS), (self.required_tags, TAGS)):
            if unknown := set(given) - set(known):
                raise ValueError(f"unknown: {sorted(unknown)}")

    @property
    def unsupported(self) -> tuple[str, ...]:
        """Kinds that were asked for by name and that nothing here finds, as no code is run."""
        return tuple(k for k in ("decoded",) if k in (self.enabled or ()))

    def wants(self, kind: str) -> bool:
        return self.enabled is None or kind in self.enabled

    @property
    def wants_quality(self) -> bool:
        return self.score_quality or self.min_quality > 0

    @property
    def annotated(self) -> bool:
        return self.annotate or bool(self.required_tags)


def selection(only=None, no=(), encodings=None) -> tuple[str, ...]:
    """Kinds of the groups `only`, without those of `no`; of static kinds those of `encodings`."""
    kinds = [k for g in (only or GROUPS) for k in GROUPS[g] if all(k not in GROUPS[x] for x in no)]
    by_encoding = {"ascii": "static_ascii", "utf8": "static_utf8", "utf16_le": "static_utf16_le", "utf16_be": "static_utf16_be"}
    return tuple(k for k in kinds if encodings is None or k not in STATIC or k in {by_encoding[e] for e in encodings})


def tag_of(text: str) -> str:
    """A tag's name, with one leading `#` and any case."""
    name = text.removeprefix("#").lower()
    if name not in TAGS:
        raise ValueError(f"unknown tag {text!r}")
    return name


def address_of(text: str) -> int:
    """A virtual address: hexadecimal after 0x, else decimal."""
    return int(text[2:], 16) if text[:2].lower() == "0x" else int(text)


def signed(x: int) -> int:
    """An unsigned 64-bit address as the long with the same bits."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x
