"""Explicit schemas of the tables that are read from or written to files."""

from __future__ import annotations

FLAG_DICTIONARY = "file string, struct_name string, field string, flag_name string, bit int, width int"

ASSIGN_LOG = "file string, field string, flag_name string, value boolean"

CHECK_RESULTS = "path string, package string, status string, error string"

_IPC = "struct<type:string,socket:string,mode:string>"
_BITREG = "struct<brf_path:string,ns_bits:int,policy:string,cap_mask:string,state_hex:string>"
_KV = (
    "struct<declare_hashes:array<struct<key_hash:string>>,"
    "values:array<struct<key_hash:string,u64_hex:string>>,encoding:string>"
)
_CONTROL = f"schema_version:int,ipc:{_IPC},bitreg:{_BITREG},kv:{_KV},seq:int,epoch_ns:bigint"

# A module's registry entry, nested under "control" or flat.
REGISTRY = f"struct<control:struct<{_CONTROL}>,{_CONTROL}>"
