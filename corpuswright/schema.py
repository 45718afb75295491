"""Table schemas."""

from __future__ import annotations

REFERENCE = "struct<url:string,type:string,title:string>"

MATERIALS = (
    "id string, source_url string, content_hash string, title string, content string, summary string,"
    " language string, tags array<string>, terms array<string>, parent_id string, order_index bigint,"
    " images array<struct<url:string,alt:string,local_path:string,description:string,idx:int,position:int>>,"
    " code_blocks array<struct<language:string,code:string,comment:string>>,"
    f" references array<{REFERENCE}>, headings array<struct<level:int,text:string>>,"
    " metadata map<string,string>, created_at double, updated_at double, source_type string"
)
