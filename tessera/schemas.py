"""Schemas of the records that operators exchange."""

CHUNK = "page_content string, metadata map<string,string>"
CODE_FILE = "source string, file_name string, suffix string, content string"
TEXT_FILE = "source string, file_name string, content string"
PDF_PAGE = "source string, file_name string, page_label string, text string"
KNN_RESULT = "query_id bigint, rank int, vec_id bigint, distance double"
RESOURCE = "filename string, birthtime timestamp, embedding boolean"
FILE_NODE = "filepath string, parent string, filename string, type string, depth int"
POSITION = "struct<line:int,column:int>"
DEFINITION = f"filepath string, type string, name string, start {POSITION}, stop {POSITION}, code string"
CALL_EDGE = "ord bigint, head_id string, head_label string, tail_id string, tail_label string, attributes map<string,string>"
MESSAGE = "conv_id bigint, turn bigint, role string, text string"
DELTA = "stream_id string, seq bigint, chunk string"
SETTING = "key string, value string"
EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
