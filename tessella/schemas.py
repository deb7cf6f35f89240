"""Schemas of the symbol relations that archives are read into."""

SCHEMA_VERSION = 3
#: The relation of class files' facts: one row of a kind, with the columns that the kind has.
FACTS = (
    "archive_path string, entry string, kind string, owner string, name string, descriptor string, access int, seq int, opcode int, "
    "ref_owner string, ref_name string, ref_desc string, text string, targets array<int>"
)
ENTRIES = "archive_path string, entry string, ord int, size long, crc long, content binary"
FAILURES = "archive_path string, error_type string, message string"
_METHOD = "source_owner string, source_name string, source_desc string"
#: The symbol relations; in the store each has a generation besides.
RELATIONS = {
    "classes": "archive_path string, internal_name string, display_name string, super_name string, access_flags int, bytecode_version int",
    "interfaces": "archive_path string, owner string, interface_name string",
    "fields": "archive_path string, owner string, name string, descriptor string, access_flags int",
    "methods": "archive_path string, owner string, name string, descriptor string, access_flags int",
    "strings": "archive_path string, owner string, method_name string, descriptor string, text string",
    "calls": f"archive_path string, {_METHOD}, target_owner string, target_name string, target_desc string",
    "field_refs": f"archive_path string, field_owner string, field_name string, field_desc string, {_METHOD}",
    "type_refs": "archive_path string, source_owner string, source_member_name string, source_member_desc string, target_type string, kind string",
    "resources": "archive_path string, entry_path string, resource_type string, text_content string",
    "modules": "archive_path string, module_name string",
    "annotations": "archive_path string, owner string, name string, descriptor string, seq int, annotation string",
    "failures": FAILURES,
}
_CALLS = f"archive_path string, {_METHOD}, target_owner string, target_name string, target_desc string"
#: Relations that are stored in buckets by a column and sorted by it: first the adjacency, in the order of ``CallGraph``, then texts by an id and their trigrams.
ADJACENCY = {
    "calls_by_source": ("source_owner", _CALLS),
    "calls_by_target": ("target_owner", _CALLS),
    "types_by_parent": ("parent", "archive_path string, parent string, child string"),
    "types_by_child": ("child", "archive_path string, parent string, child string"),
    "methods_by_owner": ("owner", "archive_path string, owner string, name string, descriptor string"),
    "strings_by_text": ("text_id", f"{RELATIONS['strings']}, text_id long"),
    "resources_by_text": ("text_id", f"{RELATIONS['resources']}, text_id long"),
    "trigrams": ("gram", "archive_path string, gram string, text_id long"),
}
GRAPH = [name for name in ADJACENCY if name.startswith(("calls", "types", "methods"))]
