"""Column functions."""

from .columns import (  # noqa: F401
    after_scheme,
    as_text,
    before_triple_slash,
    bytes_md5,
    compact_json,
    date_or,
    file_type,
    first_of,
    id_ranges,
    invalid_id_tokens,
    json_field,
    name_list,
    text_bytes,
    topup_base,
    topup_number,
    topup_type,
    is_topup,
    union_alias,
    unreadable_date,
    upper_name,
)
