"""Schemas of the landing and stored tables."""

SELECTORS = (
    "struct<link_selector:string,items_key:string,title_field:string,url_field:string,"
    "url_template:string,content_field:string,date_field:string,item_tag:string,title_tag:string,"
    "link_tag:string,date_tag:string,document_title:string,wait_selector:string,"
    "headers:map<string,string>,params:map<string,string>>"
)

SOURCES = (
    "id string, name string, state string, county string, base_url string, adapter_type string, "
    f"selectors_config {SELECTORS}, is_active boolean, health_status string, status_detail string"
)

FETCHES = (
    "document_id string, source_id string, url string, title string, document_type string, "
    "fetch_id bigint, fetched_at timestamp, content_type string, body string"
)

PAYMENT_PAYLOAD = (
    "struct<id:string,event_type:string,resource:struct<id:string,billing_agreement_id:string,"
    "plan_id:string,subscriber:struct<email_address:string,name:struct<given_name:string,surname:string>,"
    "business_name:string>,billing_info:struct<next_billing_time:string>,"
    "amount:struct<total:string,value:string,currency:string,currency_code:string>>>"
)
