"""Schemas of the entities, as DDL."""

BOX = "struct<page:int,x:double,y:double,width:double,height:double>"
LINE = "struct<x:double,y:double,width:double,height:double,t:string>"
TABLE_REF = "struct<table_id:string,row_index:int,headers:array<string>>"
PARA_ID = "struct<page:int,idx:int>"

#: What a layout reader gives besides its markdown.
LAYOUT = {
    "pages": "array<struct<page_number:int,unit:string,width:double,height:double>>",
    "paragraphs": "array<struct<page_number:int,span_offset:int,content:string,polygon:array<double>>>",
    "tables": "array<struct<table_id:string,table_no:int,page_number:int>>",
    "cells": "array<struct<table_id:string,row_index:int,column_index:int,kind:string,content:string,polygon:array<double>>>",
    "lines": "array<struct<page_number:int,content:string,polygon:array<double>>>",
}

BLOCK = f"document_id string, block_no int, page_number int, block_type string, content string, source_order int, row_order int, heading_level int, table_ref {TABLE_REF}, para_id {PARA_ID}, bbox array<{BOX}>, lines array<{LINE}>"
SOURCE_BLOCK = f"struct<para_id:{PARA_ID},bbox:array<{BOX}>,content:string>"
SECTION = f"document_id string, block_no int, page_number int, block_type string, content string, heading_path array<string>, is_heading boolean, table_ref {TABLE_REF}, table_context string, blocks array<{SOURCE_BLOCK}>"
CHUNK = f"analysis_id string, document_id string, chunk_index int, id string, page_number int, content string, token_count int, heading_path array<string>, section_path string, title string, block_type string, chunk_type string, parent_chunk_id string, table_ref {TABLE_REF}, blocks array<{SOURCE_BLOCK}>, primary_category string, secondary_categories array<string>, embedding array<float>"
REFERENCE = "struct<document_id:string,page_number:int,citation:string,block_id:string,chunk_id:string>"
ITEM = f"analysis_id string, category string, item_no int, tipo string, valor string, fecha string, hora string, expresion_relativa string, texto_original string, lugar string, monto_porcentaje double, monto_valor double, moneda string, metadata map<string,string>, confidence double, extraction_status string, source_references array<{REFERENCE}>"
ANALYSIS = "analysis_id string, analysis_name string, created_by string, status string, current_stage string, progress int, created_at timestamp, timeout_at timestamp, cancellation_requested boolean, deleted boolean, etag string"
DOCUMENT = "document_id string, analysis_id string, filename string, file_size_bytes long, page_count int, is_primary boolean, content_hash string, created_by string, uploaded_at timestamp, deleted boolean"
