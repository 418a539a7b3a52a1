"""Schemas of the stored tables and the external inputs."""

from __future__ import annotations

PACKAGE = "package_id BIGINT, name STRING, vendor STRING, alternative_names ARRAY<STRING>"
VERSION = (
    "version_id BIGINT, package_id BIGINT, name STRING, internal_identifier STRING, "
    "release_date TIMESTAMP, indexed TIMESTAMP"
)
STATIC_FILE = "file_id BIGINT, src_path STRING, webroot_path STRING, checksum BINARY"
STATIC_FILE_USE = "version_id BIGINT, file_id BIGINT"
SCAN_RESULT = "url STRING, scan_time TIMESTAMP, result STRING, scan_identifier STRING"

RELEASE_FILE = "package STRING, version STRING, path STRING, content BINARY"
TAG_REF = "package STRING, ref STRING, author_epoch BIGINT, author_offset_min INT"
DEFINITION = (
    "package STRING, vendor STRING, alternative_names ARRAY<STRING>, source STRING, "
    "version_pattern STRING, version_group INT, exclude_pattern STRING, dashed_tags BOOLEAN, "
    "path_map ARRAY<STRUCT<webroot: STRING, src: STRING>>, ignore_paths STRING"
)
RANKED_SITE = (
    "rank INT, tld_rank INT, domain STRING, tld STRING, subnets STRING, ips STRING, "
    "idn_domain STRING, idn_tld STRING, prev_rank INT, prev_tld_rank INT, "
    "prev_subnets STRING, prev_ips STRING"
)
CRAWL = (
    "url STRING, final_url STRING, status INT, "
    "headers ARRAY<STRUCT<name: STRING, value: STRING>>, body BINARY"
)
TECH_RULE = "app STRING, kind STRING, field STRING, pattern STRING"
CVE_ITEM = (
    "CVE_Items ARRAY<STRUCT<cve: STRUCT<"
    "CVE_data_meta: STRUCT<ID: STRING>, "
    "affects: STRUCT<vendor: STRUCT<vendor_data: ARRAY<STRUCT<"
    "vendor_name: STRING, product: STRUCT<product_data: ARRAY<STRUCT<"
    "product_name: STRING, version: STRUCT<version_data: ARRAY<STRUCT<"
    "version_value: STRING>>>>>>>>>>>>>"
)
GUESS_JSON = (
    "ARRAY<STRUCT<software_version: STRUCT<"
    "software_package: STRUCT<name: STRING, vendor: STRING, alternative_names: ARRAY<STRING>>, "
    "name: STRING, internal_identifier: STRING, release_date: STRING>>>"
)
