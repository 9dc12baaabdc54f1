"""Schemas of the file tables."""

from __future__ import annotations

DETECTION = "struct<provider:string,info:string,taken:timestamp_ntz>"
FLAG = "struct<flag:string,days:bigint,anchor:timestamp_ntz,files:bigint,years:bigint,hours:bigint>"
CANDIDATES, FLAGS = f"array<{DETECTION}>", f"array<{FLAG}>"

ENTRIES = (
    f"source string, destination string, taken timestamp_ntz, provider string, provider_info string, size bigint, candidates {CANDIDATES}, flags {FLAGS}, "
    "subject string, tags array<string>, caption string, orientation int, rotate string, rotate_reason string, reencode boolean, ordinal bigint"
)
SKIPPED = "source string, reason string"
