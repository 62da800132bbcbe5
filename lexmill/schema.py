"""Types of nested results."""

SENTENCE = (
    "struct<text:string,index:int,char_count:int,word_count:int,words:array<string>,pos_tags:array<string>,language:string,tier:string,"
    "confidence:double,is_topic_boundary:boolean,topic_depth_score:double,length_status:string,length_strategy_applied:string>"
)
SENTENCES = f"array<{SENTENCE}>"
SCENE = "struct<segment_id:int,text:string,estimated_duration:double,target_words:int,n_sentences:int,first_sentence:int>"
SCENES = f"array<{SCENE}>"
SUBTITLES = "array<struct<text:string,display_order:int,start_time:double,duration:double,parent_segment_id:int>>"
