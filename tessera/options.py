"""Options of decoding and encoding. Immutable; later settings win through `but()`."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class DecodeOptions:
    """use_number: dynamic numbers keep their text. zero_fill: null scalars become zero values. fold_keys: a key that no
    field has exactly is matched without regard to case. native: let built-in parsing handle documents it is exact on."""

    use_number: bool = False
    zero_fill: bool = False
    fold_keys: bool = True
    native: bool = True

    def but(self, **changes: object) -> "DecodeOptions":
        return replace(self, **changes)


@dataclass(frozen=True)
class EncodeOptions:
    """escape_html: < > & as \\u003c \\u003e \\u0026. escape_line_terms: U+2028 and U+2029 escaped. utf8_correction:
    invalid bytes become U+FFFD. float_exp_auto: exponents below 1e-6 and from 1e21. prefix, indent: pretty printing,
    which takes a non-empty indent. max_depth: nested values deeper than this are an error (None: no limit)."""

    escape_html: bool = False
    escape_line_terms: bool = False
    utf8_correction: bool = False
    float_exp_auto: bool = False
    prefix: str = ""
    indent: str = ""
    max_depth: int | None = 64

    def but(self, **changes: object) -> "EncodeOptions":
        return replace(self, **changes)

    def std_compat(self) -> "EncodeOptions":
        """All escapes, correction and automatic exponents."""
        return self.but(escape_html=True, escape_line_terms=True, utf8_correction=True, float_exp_auto=True)

    def fast_escape(self) -> "EncodeOptions":
        """Only what JSON itself demands is escaped."""
        return self.but(escape_html=False, escape_line_terms=False, utf8_correction=False)
