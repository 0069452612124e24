"""Column functions (``Column -> Column``), all built-in Spark expressions."""

from .numbers import (micros_to_nsec, micros_to_sec, unsigned_field_ok,
                      unsigned_field_value)
from .priority import (facility_of, format_priority, priority_ok,
                       priority_value, severity_of)
from .text import bytes_after, cut_bytes, first_line, octets
from .timefmt import format_rfc3339

__all__ = [
    "bytes_after", "cut_bytes", "facility_of", "first_line", "format_priority",
    "format_rfc3339", "micros_to_nsec", "micros_to_sec", "octets",
    "priority_ok", "priority_value", "severity_of", "unsigned_field_ok",
    "unsigned_field_value",
]
