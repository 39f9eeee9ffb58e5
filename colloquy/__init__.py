"""Colloquy: a Spark-native engine that turns message tables into conversation forests."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

#: Public names and their modules; a module is loaded when its first name is asked for, so workers load what they run.
_HOMES = {
    "colloquy.functions.headers": ("REFERENCE_PATTERN", "effective_references", "email_fingerprint", "extract_reference_ids", "normalize_message_id", "reference_ids"),
    "colloquy.functions.text": ("base_subject", "decode_header_text", "is_reply_or_forward_subject", "is_reply_subject", "normalize_subject", "unicode_casemap_key"),
    "colloquy.functions.dates": ("EARLIEST", "normalize_sent_date", "sent_us"),
    "colloquy.operators.forest": ("add_child", "descendants", "has_descendant", "preorder", "with_payload"),
    "colloquy.operators.render": ("ThreadSerializationError", "response_text", "serialize_thread_data", "serialize_thread_response", "thread_texts"),
    "colloquy.operators.threading": ("SequenceNumberError", "thread_messages"),
    "colloquy.schema": ("MESSAGE_SCHEMA", "NODE_SCHEMA", "as_mailbox"),
    "colloquy.session": ("session", "ship"),
    "colloquy.staging": ("clear_scratch",),
    "colloquy.sources.mail": ("parse_emails", "read_eml", "read_mbox", "thread_email_messages"),
    "colloquy.streaming.incremental": ("IncrementalThreads",),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'colloquy' has no attribute {name!r}")
    return getattr(importlib.import_module(_HOME[name]), name)
