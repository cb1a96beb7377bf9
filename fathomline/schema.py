"""The fixed feature table: service columns, 85 features in order, and the columns that models read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names, types and order of the feature columns, by section.
SECTIONS: dict[str, str] = {
    "common": "size_bytes int, log_size float, magic_ok bool, format_family str, magic_family str, fallback_used bool, fallback_format_family str",
    "gzip": "gzip_header_ok bool, gzip_mtime_present bool, gzip_name_present bool, parser_ok bool, structure_consistent bool",
    "jpeg": "jpeg_header_ok bool, jpeg_sof_present bool, jpeg_sos_present bool, jpeg_exif_present bool, jpeg_segments_count int",
    "mp4": "mp4_ftyp_present bool, mp4_moov_present bool, mp4_mdat_present bool, mp4_box_tree_ok bool",
    "ole2": "ole_dir_ok bool, ole_stream_count int, ole_fat_ok bool, ole_mini_fat_ok bool, ole_root_entry_present bool, ole_summaryinfo_present bool, ole_expected_streams_present bool",
    "ooxml": "ooxml_detected bool, ooxml_coreparts_present bool, ooxml_rel_count int, ooxml_pkg_ok bool, ooxml_content_types_valid bool, ooxml_relationships_graph_valid bool",
    "pdf": "pdf_has_trailer bool, pdf_startxref_found bool, pdf_xref_ok bool, pdf_obj_count_est float, pdf_ids_present bool, pdf_root_present bool, pdf_trailer_ok bool, pdf_version float",
    "png": "png_header_ok bool, png_ihdr_ok bool, png_chunks_count int, png_idat_count int, png_end_iend_ok bool",
    "rar": "rar_header_ok bool, rar_main_header_flags_ok bool, rar_file_records_count int, rar_version_5 bool",
    "zip": "zip_central_dir_ok bool, zip_cd_offset_ok bool, zip_entry_count int, zip_has_content_types bool, zip_comment_len int, zip_names_utf8_fraction float, zip_crc_present_fraction float",
    "7zip": "7zip_start_header_crc_valid bool, 7zip_next_header_layout_valid bool, 7zip_next_header_crc_valid bool, 7zip_header_marker_valid bool, 7zip_header_sections_valid bool",
    "pdf_enc": "pdf_encrypt_dict_present bool, pdf_encrypt_filter str, pdf_encrypt_metadata bool",
    "ole2_enc": "encrypted_package_present bool, ooxml_encryption_info_present bool, ooxml_encryption_type str, ole_format_family str, ole_encryption_present bool, ole_encryption_struct_valid bool, ole_write_protection_present bool",
    "zip_enc": "zip_any_entry_encrypted bool, zip_encryption_method str, zip_all_headers_encrypted bool",
    "7zip_enc": "7zip_needs_password bool, 7zip_aes_method_present bool, 7zip_names_hidden_likely bool",
    "statistic": "entropy_global float, min_entropy_global float, entropy_head float, entropy_tail float, byte_chi2 float, ic_index float",
}

KINDS = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType()}

#: name -> kind, the first of equal names.
FEATURES: dict[str, str] = {}
for _section in SECTIONS.values():
    for _name, _kind in (x.split() for x in _section.split(", ")):
        FEATURES.setdefault(_name, _kind)

SERVICE: dict[str, str] = {
    "path": "string", "gt_class": "string", "sequence_id": "int", "orig_ext": "string", "extra": "string", "curr_ext": "string",
    "group_id": "string", "pair_id": "string", "is_augmented": "boolean", "aug_encryption": "string", "aug_parent": "string",
}

#: Class names in label order.
LABELS = ("benign", "benign-encrypted", "ransomware-encrypted")

NUMERIC = [n for n, k in FEATURES.items() if k != "str"]
SCALED = [n for n, k in FEATURES.items() if k in ("int", "float") and n != "pdf_version"]

FEATURE_STRUCT = T.StructType([T.StructField(n, KINDS[k]) for n, k in FEATURES.items()])


def quoted(name: str) -> str:
    return f"`{name}`"


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """df, if it has the columns; else an error that names those it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df


def require_exact(df: DataFrame) -> DataFrame:
    """df, if its columns are the feature schema, neither more nor fewer; in schema order."""
    missing, extra = [c for c in FEATURES if c not in df.columns], [c for c in df.columns if c not in FEATURES]
    if missing or extra:
        raise RuntimeError(f"feature schema mismatch: missing {missing}, extra {extra}")
    return df.select(*map(quoted, FEATURES))
