"""Declared schemas (DDL); sources are read with these, never inferred."""

URL_INFO = "struct<url:string,domain:string,visible_text:string>"
ATTACHMENT = "struct<filename:string,mime_type:string,size:bigint,sha256:string>"
SENDER_HISTORY = (
    "struct<total_threads:int,is_first_time_sender:boolean,has_user_replied:boolean,"
    "oldest_thread_iso_date:string,spam_count:int,trash_count:int,available:boolean>"
)
RECENT_EMAIL = (
    "struct<subject:string,body_snippet:string,received_iso_date:string,"
    "has_attachments:boolean,url_count:int>"
)
MESSAGE = (
    "message_id string, mailbox_id string, thread_id string, received_at timestamp,"
    "subject string, from_email string, from_domain string, reply_to_email string,"
    "reply_to_domain string, return_path string, authentication_results string,"
    f"body_text string, body_html string, urls array<{URL_INFO}>,"
    f"attachments array<{ATTACHMENT}>, sender_history {SENDER_HISTORY},"
    f"recent_emails_from_sender array<{RECENT_EMAIL}>"
)
RAW_MESSAGE = "message_id string, raw_json string"
MAILBOX_MESSAGE = (
    "mailbox_id string, thread_id string, message_id string, sender string,"
    "recipient string, folder string, received_at timestamp, subject string,"
    "body string, n_attachments int"
)
REPUTATION_BODY = "kind string, target string, body string"
VT_RESULT = (
    "struct<kind:string,target:string,malicious_count:int,suspicious_count:int,"
    "harmless_count:int,undetected_count:int,timeout_count:int,total_engines:int,"
    "reputation:int,first_submission_date:bigint,last_analysis_date:bigint,"
    "total_votes_harmless:int,total_votes_malicious:int,title:string,"
    "last_final_url:string,threat_names:array<string>,categories:map<string,string>,"
    "tags:array<string>,meaningful_name:string,type_description:string,type_tag:string,"
    "size:bigint,sha256:string,md5:string,sha1:string,names:array<string>,"
    "threat_label:string,creation_date:bigint,registrar:string,country:string,"
    "asn:bigint,as_owner:string,network:string,is_malicious:boolean>"
)
ABUSE_RESULT = (
    "struct<ip:string,abuse_confidence:int,country_code:string,country_name:string,"
    "usage_type:string,isp:string,domain:string,hostnames:array<string>,"
    "total_reports:int,distinct_reporters:int,last_reported_at:string,"
    "is_whitelisted:boolean,is_tor:boolean,recent_report_categories:array<array<int>>>"
)
SAFE_BROWSING = (
    "struct<url:string,is_threat:boolean,threat_types:array<string>,"
    "platform_types:array<string>>"
)
MALWARE_FEED = (
    "struct<url:string,in_database:boolean,threat:string,tags:array<string>,"
    "url_status:string,date_added:string,reporter:string>"
)
EXPANSION = (
    "struct<original_url:string,final_url:string,redirect_chain:array<string>,"
    "redirect_count:int,expanded:boolean,error:string>"
)
# what scoring and the reports read of a reputation record
VT_LOOKUP = (
    "struct<kind:string,target:string,malicious_count:int,total_engines:int,"
    "first_submission_date:bigint,creation_date:bigint,threat_names:array<string>,"
    "categories:map<string,string>,type_description:string,threat_label:string>"
)
INTEL = (
    f"struct<url_results:array<{VT_LOOKUP}>,file_results:array<{VT_LOOKUP}>,"
    f"domain_results:array<{VT_LOOKUP}>,ip_results:array<{VT_LOOKUP}>,"
    f"abuse_result:{ABUSE_RESULT},url_expansions:array<{EXPANSION}>,sender_ip:string,"
    f"safe_browsing_results:array<{SAFE_BROWSING}>,malware_feed_results:array<{MALWARE_FEED}>>"
)
REDIRECT = "src string, dst string"
RAW_ANSWER = "message_id string, raw_text string"
ANSWER = (
    "struct<score:int,threat_category:string,main_findings:array<string>,"
    "potential_damage:string,do:array<string>,do_not:array<string>,available:boolean>"
)
SIGNAL = (
    "struct<code:string,layer:string,score:int,severity:string,title:string,"
    "explanation:string>"
)
SUFFIX_RULE = "suffix string"


def fields_of(struct_ddl: str) -> list[str]:
    """Field names of one of the struct declarations above."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(struct_ddl)
    assert isinstance(parsed, StructType)
    return parsed.names
