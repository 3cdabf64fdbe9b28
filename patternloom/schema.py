"""Row layouts of documents, pairs, seeds, statistics and scores."""

PAIRS = "docid string, context string, pattern string"
SEEDS = "id string, context string, pattern string, weight double"
STATS = "id string, context string, pattern string, matches long, global_pattern_count long, global_context_count long, weight double"
SCORES = "id string, context string, pattern string, score double"
#: begin and end: offsets in the text; dep_index: 1-based head, 0 for the root; coref_id: -1 for none
TOKEN = "struct<token:string,begin:int,end:int,lemma:string,pos:string,chunk:string,ne:string,dep_type:string,dep_index:int,coref_id:int>"
PARSED = f"docid string, sentences array<array<{TOKEN}>>"
TWEET = "struct<id:long,text:string,created_at:string,retweeted:boolean,user:struct<screen_name:string,location:string>,geo:struct<type:string,coordinates:array<double>>>"

#: stands for an open side inside a composed context; whole missing fields are NULL
ANY = "*"
PIPE = "|"
