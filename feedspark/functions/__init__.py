"""Column functions: codec (base64, XOR, byte sums) and text helpers."""

from feedspark.functions.codec import (  # noqa: F401
    b64_decode_lenient,
    b64_decode_prefix,
    b64_encode,
    b64_prefix,
    byte_sum,
    xor_authenticate,
    xor_bytes,
    xor_bytes_native,
)
from feedspark.functions.text import (  # noqa: F401
    atoi,
    audit_time,
    count_char,
    key_valid,
    refresh_seconds,
    split_fields,
    trim_spaces_tabs,
)
