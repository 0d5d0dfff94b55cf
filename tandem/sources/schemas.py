"""Declared schemas of the inputs; nothing is inferred from data."""

ARTICLES_B = (
    "title string, url string, scraped_at string, data struct<title:string,url:string,main_title:string,"
    "sections:array<struct<level:string,id:string,title:string,content:array<struct<type:string,text:string,items:array<string>>>>>,"
    "paragraphs:array<string>,tables:array<struct<headers:array<string>,rows:array<array<string>>>>,"
    "references:array<struct<text:string,link:struct<href:string,text:string>>>,"
    "metadata:struct<has_edits:boolean,fact_check_timestamp:string,edits_count:int>>"
)
ARTICLES_A = (
    "name string, sections array<struct<name:string,has_parts:array<struct<value:string,text:string>>>>,"
    "references array<struct<text:string,citation:string,url:string,metadata:struct<url:string,text:string,title:string,isbn:string,isbn10:string,isbn13:string,citation:string,note:string>>>"
)
RELIABILITY = "source string, status string"
SCORES = "domain string, pc1 double"
GEO_VIEWS = "project string, page_id bigint, country_code string, noisy_views bigint"
METADATA = "title string, original_title string, quality_data struct<class:string,quality:double>, topic_data struct<prediction:struct<results:array<struct<topic:string,score:double>>>>, errors array<string>"
FIXED_ISSUES = "slug string, fixedIssues array<struct<criticality:string,issueType:string>>, fixedIssuesCount bigint, fetched_at string"
EDIT_REQUESTS = "slug string, editRequests array<struct<id:string,status:string,summary:string>>, totalCount bigint, hasMore boolean, fetched_at string"
FAILURES = "slug string, error string, status_code int, failed_at string"
CHUNKS = "title string, source string, chunk_id bigint, text string, emb_ix bigint"
