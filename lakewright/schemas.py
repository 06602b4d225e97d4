"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "sources": "id int, slug string, name string, base_url string, adapter string, tier int, jurisdiction_level string, state string, licence string, robots_crawl_delay double, robots_allows boolean, audited_at timestamp, refresh_days int, active boolean",
    "raw_documents": "id bigint, source_id int, url string, content_hash string, content_type string, http_status int, body_path string, body_bytes bigint, meta map<string,string>, fetched_at timestamp",
    "extraction_queue": "id bigint, raw_document_id bigint, tier int, status string, attempts int, model_used string, last_error string, claimed_at timestamp, completed_at timestamp, created_at timestamp",
    "payload": "canonical_name string, colloquial_names array<string>, kind string, jurisdiction_level string, state string, ministry string, what_it_is string, who_is_eligible string, exclusions string, documents_required array<string>, fee_amount double, fee_notes string, how_to_apply array<string>, application_modes array<string>, online_url string, processing_time string, validity string, helpline string, email string, office_address string, grievance_route string, page_is_about_a_service boolean, fields_not_stated array<string>",
    "catalogue_feed": "slug string, title string, description string, ministry string, npiMinistry string, schemeCategory array<string>, beneficiaryState string, tags array<string>",
    "page_feed": "slug string, title string, url string, ok boolean, status int, error string, content_hash string, text string, text_len_visible_only int, sections_found array<string>, links array<struct<text:string,href:string>>, fetched_at string",
    "static_feed": "id string, title string, url string, status string, kind string, http_status int, content_hash string, body_bytes bigint, pages int, detail string, text string, tables array<string>, fetched_at string",
    "link_checks": "url string, status string, http_status int, detail string, verified boolean, checked_at timestamp",
    "directory_records": "dataset_id string, dataset_title string, row string, state string, district string, pincode string, lat double, lon double",
    "catalogue": "slug string, title string, description string, categories array<string>, tags array<string>, ministry string, state string, url string, updated_at timestamp, embedding array<float>",
    "canonical_record": "id string, canonical_name string, aliases array<string>, colloquial_names array<string>, kind string, jurisdiction struct<level:string,state:string>, owner struct<ministry:string,department:string,agency:string>, life_events array<string>, categories array<string>, what_it_is string, documents_required array<struct<name:string,mandatory:boolean,notes:string,accepted_alternatives:array<string>>>, fees struct<amount:double,currency:string,varies:boolean,waivers:array<string>,notes:string>, processing_time string, validity string, renewal string, helpline string, grievance_route string, sources array<struct<url:string,fetched_at:timestamp,http_status:int,content_hash:string,snapshot_path:string,licence:string>>, field_provenance map<string,int>, confidence double, last_verified_at timestamp, link_status string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> list[str]:
    return sorted(_DDL) + ["service_records"]


def service_records() -> StructType:
    return StructType.fromDDL(
        f"id string, canonical_name string, kind string, jurisdiction_level string, state string, ministry string, life_events array<string>, payload struct<{', '.join(':'.join(p.split(' ', 1)) for p in _DDL['payload'].split(', '))}>, confidence double, link_status string, last_verified_at timestamp, updated_at timestamp, embedding array<float>"
    )
