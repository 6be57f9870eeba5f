"""Explicit schemas of the record tables (never inferred)."""

DICT = ("struct<reading:string,kanji:boolean,no_kanji:boolean,priorities:array<string>,"
        "reading_info:array<string>,is_main:boolean>")
GLOSS = "struct<id:smallint,gloss:string,g_type:string>"
GAIRAIGO = "struct<language:string,fully_derived:boolean,original:string>"
SENSE = (f"struct<id:smallint,misc:string,field:string,dialect:string,glosses:array<{GLOSS}>,"
         "xref:string,antonym:string,information:string,part_of_speech:array<string>,"
         f"language:string,example_sentence:bigint,gairaigo:{GAIRAIGO}>")
RADICAL = ("struct<id:int,literal:string,alternative:string,stroke_count:tinyint,"
           "readings:array<string>,translations:array<string>>")

# ids are BIGINT: a bulk lexicon outgrows 32 bits
WORDS = (f"sequence bigint, common boolean, reading struct<kana:{DICT},kanji:{DICT},"
         f"alternative:array<{DICT}>>, senses array<{SENSE}>, furigana string, "
         "jlpt_lvl tinyint, collocations array<bigint>, transive_version bigint, "
         "intransive_version bigint, sentences_available int, accents array<tinyint>")
KANJI = ("literal string, grade tinyint, stroke_count tinyint, frequency bigint, jlpt tinyint, "
         "variant array<string>, onyomi array<string>, nanori array<string>, "
         "kunyomi array<string>, chinese array<string>, korean_r array<string>, "
         "korean_h array<string>, vietnamese array<string>, kun_dicts array<bigint>, "
         "on_dicts array<bigint>, similar_kanji array<string>, meanings array<string>, "
         f"radical {RADICAL}, parts array<string>")
NAMES = ("sequence bigint, kana string, kanji string, transcription string, "
         "name_type array<string>, xref string")
SENTENCES = ("id bigint, japanese string, furigana string, "
             "translations array<struct<text:string,language:string>>, jlpt_guess tinyint, "
             "level tinyint, tags array<string>")
RADICALS = "literal string, frequency bigint, meanings array<string>, stroke_count int"
HASHTAGS = "tag string, s_targets array<tinyint>, freq float"
NEWS = ("id bigint, title string, long string, short string, creation_time timestamp, "
        "was_trimmed boolean")
IDS_EDGES = "parent string, pos int, child string, origin string"
MORPHEMES = ("text_id bigint, pos bigint, surface string, lexeme string, reading string, "
             "word_class string")
RAW_QUERIES = ("query_id bigint, raw_query string, target string, user_lang string, "
               "show_english boolean, page int, page_size int, word_index int, "
               "lang_overwrite string")

# landing schemas of the raw imports
RAW_ENTRIES = ("sequence bigint, "
               "element array<struct<kanji:boolean,value:string,priority:array<string>,"
               "reading_info:array<string>,no_true_reading:boolean>>, "
               "sense array<struct<id:smallint,gloss:array<struct<language:string,g_type:string,"
               "value:string>>,misc:string,part_of_speech:array<string>,antonym:string,"
               "field:string,xref:string,dialect:string,information:string,"
               f"gairaigo:{GAIRAIGO},example_sentence:bigint>>")
RAW_NAMES = ("sequence bigint, kana_element string, kanji_element string, "
             "transcription string, name_type array<string>, xref string")
RAW_CHARACTERS = ("literal string, on_reading array<string>, kun_reading array<string>, "
                  "chinese_reading array<string>, korean_romanized array<string>, "
                  "korean_hangul array<string>, vietnamese array<string>, "
                  "meaning array<string>, grade int, stroke_count int, variant array<string>, "
                  "frequency bigint, jlpt int, nanori array<string>, radical int")

RECORD_SCHEMAS = {"words": WORDS, "kanji": KANJI, "names": NAMES, "sentences": SENTENCES}
RAW_SCHEMAS = {"entry": RAW_ENTRIES, "name": RAW_NAMES, "character": RAW_CHARACTERS}
