"""Patterns, word lists and limits that results depend on. Patterns are written for a dialect whose
``\\b`` and ``\\w`` are ASCII and whose ``\\s`` is all Unicode white space; patterns.py translates them."""

# Memory types from text, in the order in which they are tried.
TECHNICAL = r"\b(?:api|database|function|script|service|tool|https|shell|floating[- ]point|error|bug|code|session\.py|review|schema|json|permissions?|polic(?:y|ies)|token|credential|time\s+window|execution\s+window|quote\s+window|threshold|constraint)\b|技術|程式|服務|資料庫|浮點|錯誤|審查|權限|規範|憑證|金鑰|密碼|時間窗口|執行時間|秒之間|門檻|限制條件"
TRANSIENT = r"\b(?:currently|current progress|score|moves?|in progress|right now)\b|目前|當前|進度|分數|步數"
COMPLETED_EVENT = r"\b(?:review|audit|test|migration|deployment)\b[^.!?\n]{0,160}\b(?:was|were|has been|had been)\s+(?:performed|executed|run|completed)\b|(?:已|曾)(?:完成|執行|進行)[^。！？\n]{0,120}(?:審查|稽核|測試|遷移|部署)|(?:審查|稽核|測試|遷移|部署)[^。！？\n]{0,120}(?:已完成|已執行|已進行)"
PROJECT = r"\b(?:added|installed|download(?:ed| failures?)?|verified|not added|replaced|blocked|completed|deployed|deferred|updated?|implemented|fixed|rewrit(?:e|es|ing|ten)|task (?:was )?initiated|initiated a task|(?:the\s+)?task\s+(?:now\s+)?requires?|fresh\s+closure\s+review|needs? revision|not yet implemented|scope boundary|stage (?:is |was )?(?:strictly )?defined)\b|已加入|未加入|下載失敗|已驗證|完成|阻塞|延後|範圍邊界|已修正|尚未實作|未結案|更新|實施|修補|改寫|重寫|執行[^。！？\n]{0,40}任務"
EVENT = r"\b(?:demonstrated|performed|executed|ran|showed)\b|展示|執行|進行"

# Polarity of any text.
GENERAL_NEGATIVE = r"\b(?:does not prefer|doesn't prefer|dislikes?|hates?|avoids?|rejects?|must not|should not|not)\b|不喜歡|不偏好|不要|反對|不得|不應"
GENERAL_POSITIVE = r"\b(?:prefers?|must|should)\b|\b(?:i|we|you|they|he|she|user|arthur|nancy)\s+(?:really\s+)?(?:likes?|requires?|wants?)\b|偏好|喜歡|要求|希望|必須|應該"

# Aliases, replaced in this order.
ALIASES = (
    (r"深色模式|暗色模式|dark\s+mode", " dark_mode "),
    (r"所有(?:裝置|設備)|全部(?:裝置|設備)|all\s+devices?|every\s+device", " all_devices "),
    (r"(?:行動|移動)(?:裝置|設備)|手機|mobile\s+devices?|phones?", " mobile_device "),
    (r"桌上型電腦|桌機|電腦|desktop(?:\s+computers?)?", " desktop_device "),
    (r"夜間|晚上|night(?:time)?|evenings?", " night_time "),
    (r"安全(?:警示|通知)|security\s+(?:alerts?|notifications?)", " security_alert "),
    (r"繁體中文|正體中文|traditional\s+chinese", " traditional_chinese "),
    (r"互動|溝通|interactions?|communications?", " interaction "),
    (r"書面|written", " written_interaction "),
    (r"口語|語音|spoken|voice", " voice_interaction "),
    (r"第三人稱|third[- ]person", " third_person "),
    (r"短(?:篇)?遊戲|short(?:er)?\s+games?", " short_game "),
    (r"先行|優先|先玩|first|before", " first "),
    (r"生成(?:模型)?路由|generation\s*(?:route|routing|路由)", " generation_routing "),
    (r"通知|notifications?", " notifications "),
    (r"即時反應|real[- ]time\s+reactions?", " realtime_reaction "),
    (r"實況|直播|live\s+stream(?:ing)?", " live_stream "),
    (r"穿插|交錯|inline|interleav\w*|threaded|interspers\w*", " inline_interleave "),
    (r"故事|小說|情節|敘事|寫作|story|stories|narrative|narration|writing|novel", " narrative "),
    (r"分段|separate[ds]?|end[- ]of[- ](?:episode|section)", " separated "),
    (r"用戶|使用者|user", " "),
    (r"\b(?:does\s+not|doesn't|do\s+not|don't)\s+(?:prefer|like|want|require)\b", " "),
    (r"不喜歡|不偏好|比較喜歡|更喜歡|偏好|喜歡|不要|要求|希望", " "),
    (r"\b(?:i|we|you|they|he|she|arthur|nancy)\s+(?:really\s+)?likes?\b", " "),
    (r"prefers?|preference|dislikes?|requires?|wants?", " "),
    (r"模型|\bmodels?\b|\busing\b|\bplaying\b|玩", " "),
    (r"(?:設定為|使用|採用|進行|撰寫|書寫|回覆|回答|在|於|以|用)", " "),
)
STOP_TOKENS = ("a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "rather", "such", "than", "that", "the", "their", "this", "to", "where", "with", "within", "would")

# Preferences tied to an actor.
ACTOR_PREFERENCE = r"\b(?:i|we|you|they|he|she|user|arthur|nancy)\s+(?:(?:explicitly|clearly|really)\s+)?(?:prefers?|dislikes?|likes?|requires?|wants?)\b"
ACTOR_NEGATIVE_PREFERENCE = r"\b(?:i|we|you|they|he|she|user|arthur|nancy)\s+(?:(?:explicitly|clearly|really)\s+)?(?:does\s+not|doesn't|do\s+not|don't)\s+(?:prefer|like|want|require)\b"
ACTOR_PREFERENCE_NOUN = r"\b(?:(?:my|our|your|their|his|her)\s+preference|(?:user|arthur|nancy)(?:'s)?\s+preference|(?:i|we|you|they|he|she|user|arthur|nancy)\s+would\s+rather)\b"
CHINESE_PREFERENCE = r"(?:用戶|使用者|我|我們|Nancy)\s*(?:的)?\s*(?:明確|清楚|最新|現在)?\s*(?:偏好|比較喜歡|更喜歡|不喜歡|喜歡|要求|希望)"

# Directives of one session and rules that outlast it.
DURABLE_SCOPE = r"(?:以後|今後|往後|未來|每次|每一步|每一(?:次|步)|一律|總是|預設|默認|自動(?!化)|除非|沒有[^。！？\n]{0,40}阻塞|無[^。！？\n]{0,40}阻塞|不用[^。！？\n]{0,40}(?:詢問|問我)|不需要[^。！？\n]{0,40}(?:詢問|問我))|\b(?:from\s+now\s+on|going\s+forward|in\s+the\s+future|always|every\s+(?:time|step)|by\s+default|automatically|autonomously|unless|whenever|without\s+asking|do\s+not\s+ask\s+me\s+every|don't\s+ask\s+me\s+every|if\s+(?:there\s+is\s+|there's\s+)?no\s+blocker|when\s+(?:there\s+is\s+|there's\s+)?no\s+blocker)\b"
OPERATIONAL_BEHAVIOUR = r"(?:繼續|開始|執行|往下|詢問|問我)|\b(?:continue|proceed|resume|execute|execution|ask|autonomous|autonomously)\b"
ONE_SHOT = (
    r"^(?:請|麻煩)?\s*(?:直接)?\s*(?:開始(?:吧|執行(?:任務)?|任務)?|繼續(?:吧|執行|完成|進行|做|往下)?|下一步|往下|進行下一步|恢復(?:吧|執行)?|目前進度(?:如何|呢|怎樣|怎麼樣)?)\s*[吧嗎呢啊喔哦?？!！。]*$",
    r"^(?:please\s+)?(?:just\s+)?(?:start|begin|continue|proceed|go\s+ahead|keep\s+going|resume)(?:\s+(?:the\s+)?(?:task|work|execution|process))?\s*[?!.]*$|^(?:please\s+)?(?:the\s+)?next\s+step\s*[?!.]*$|^what(?:'s|\s+is)\s+(?:the\s+)?current\s+progress\s*[?!.]*$",
    r"(?:用戶|使用者)\s*(?:要求|希望|指示|請求)\s*(?:(?:Agent|代理|助理)\s*)?(?:開始|繼續|往下|進行下一步|恢復)(?:\s*(?:執行|完成|進行))?(?:\s*(?:任務|工作|流程))?",
    r"\b(?:the\s+)?user\s+(?:asked|requested|told|instructed|wanted)\s+(?:(?:the\s+)?agent\s+)?(?:to\s+)?(?:start|begin|continue|proceed|resume|keep\s+going|go\s+ahead)(?:\s+(?:the\s+)?(?:task|work|execution|process))?\b|\b(?:the\s+)?user\s+(?:asked|requested)\s+(?:for\s+)?(?:the\s+)?(?:task|work|execution|process)\s+to\s+(?:start|begin|continue|proceed|resume)\b",
    r"(?:用戶|使用者)\s*(?:詢問|要求|想知道)[^。！？\n]{0,32}(?:目前|當前)?\s*進度|\b(?:the\s+)?user\s+(?:asked|requested|wanted\s+to\s+know)[^.!?\n]{0,48}(?:current\s+)?progress\b",
)
TASK_REQUEST = r"(?:用戶|使用者)\s*(?:要求|希望|指示|請求)\s*(?:審查|檢查|研究|分析|測試|執行|處理|建立|製作|撰寫|輸出|回報)|\b(?:the\s+)?user\s+(?:requires?|wants?|asks?|requests?)\b[^.!?]{0,60}\b(?:review|audit|analysis|research|test|execute|build|create|produce|output|report)\b"
PREFERENCE_VERB = r"\b(?:prefers?|likes?|dislikes?|would\s+rather)\b|(?:偏好|喜歡|不喜歡|比較喜歡|更喜歡)"
PREFERENCE_EXPERIMENT = r"\b(?:a\/?b\s+test(?:ing)?|test(?:ing)?|experiment(?:ing)?|compar(?:e|ing|ison))\b[^.!?]{0,160}\b(?:preference|style|narrative)\b|(?:測試|實驗|比較)[^。！？]{0,160}(?:偏好|風格|敘事)"

# Placement of live commentary.
LIVE_COMMENTARY = r"nancy|live|stream|commentary|實況|直播|操作|吐槽|反應"
PLACEMENT = r"inline|interleav|threaded|interspers|within|directly|separate|end[- ]of[- ](?:episode|section)|穿插|交錯|直接|分段|章末"
NARRATIVE = r"story|stories|narrative|novel|episode|section|format|style|故事|小說|情節|段落|正文|格式|風格"
INLINE_RULE = r"\b(?:live\s+content|commentary|nancy|novel|story|narrative|format|style)\b[^.!?\n]{0,180}\b(?:must|should|needs?\s+to|is\s+required\s+to)\b[^.!?\n]{0,220}\b(?:inline|interleav\w*|threaded|interspers\w*|directly|within)\b"
CHINESE_INLINE_RULE = r"(?:實況|直播|操作|吐槽|反應|小說|故事|情節|正文|格式|風格)[^。！？\n]{0,180}(?:必須|應該|需要|需直接|不得|不可)[^。！？\n]{0,220}(?:穿插|交錯|直接|正文)"

# Polarity within reviewed concepts.
NEGATIVE_PREFERENCE = r"\b(?:does\s+not|doesn't|do\s+not|don't)\s+(?:prefer|like|want|require)\b|\b(?:prefers?|wants?|requires?)\b[^.!?]{0,60}\b(?:no|without)\b|\b(?:dislikes?|rejects?|avoids?)\b|不偏好|不喜歡|不要|拒絕|反對"
POSITIVE_PREFERENCE = r"\b(?:prefers?|preference|likes?|requires?|wants?)\b|偏好|喜歡|要求|希望"
NEGATED_EXPRESSION = r"\b(?:does\s+not|doesn't|do\s+not|don't)\s+(?:prefer|like|want|require)\b|\b(?:prefers?|wants?|requires?)\b[^.!?]{0,60}\b(?:no|without)\b|不偏好|不喜歡|不要"
QUALIFIER = r"\b(?:but|however|except|excluding)\b|但|可是|不過|除了|排除"
POSITIVE_INLINE = r"\b(?:prefers?|requires?|must|should)\b[^.!?]{0,220}(?:inline|interleav|threaded|interspers|directly|within)|(?:偏好|要求|必須|應該|需要)[^。！？]{0,220}(?:穿插|交錯|直接|正文)"
NEGATIVE_INLINE = r"\b(?:dislikes?|hates?|avoids?|rejects?)\b[^.!?]{0,80}(?:inline|interleav|threaded|interspers)|\b(?:prefers?|wants?|requires?)\b[^.!?]{0,80}\b(?:no|without)\b[^.!?]{0,80}(?:inline|interleav|threaded|interspers)|不(?:喜歡|要|應該)[^。！？]{0,48}(?:穿插|交錯|直接)"
RULED_OUT_INLINE = r"\b(?:(?:must|should)(?:\s+not|n't)|can\s+not|cannot|can't)\b[^.!?]{0,120}(?:inline|interleav|threaded|interspers)|(?:不得|不應該|不應|不可)[^。！？]{0,120}(?:穿插|交錯|直接)"
WANTS_SEPARATE = r"\b(?:prefers?|requires?|wants?)\b[^.!?]{0,100}(?:separate[ds]?|end[- ]of[- ](?:episode|section))|(?:偏好|要求|希望)[^。！？]{0,100}(?:分段|獨立實況|章末實況)"
CONTRAST = r"\brather\s+than\b|\binstead\s+of\b|而非|而不是|而不|不是"
REJECTS_SEPARATE = r"\b(?:dislikes?|hates?|avoids?|rejects?)\b(?:(?!inline|interleav\w*|threaded|interspers\w*)[^.!?]){0,180}(?:separate[ds]?|end[- ]of[- ](?:episode|section)|episode[^.!?]{0,80}(?:stream|commentary))|(?:不喜歡|拒絕|不要)(?:(?!穿插|交錯|直接)[^。！？]){0,180}(?:分段|章末|結尾[^。！？]{0,80}(?:實況|直播|吐槽))"
HAS_INLINE = r"inline|interleav\w*|threaded|interspers\w*|穿插|交錯|直接"
HAS_SEPARATE = r"separate[ds]?|end[- ]of[- ](?:episode|section)|分段|章末|結尾"
THIRD_PERSON_NEGATIVE = r"\b(?:dislikes?|hates?|avoids?|rejects?|does\s+not\s+prefer|doesn't\s+prefer)\b[^.!?]{0,100}third[- ]person|(?:不喜歡|不偏好|拒絕|不要)[^。！？]{0,100}第三人稱"
THIRD_PERSON_POSITIVE = r"\b(?:prefers?|likes?|requires?|wants?)\b(?:(?!first[- ]person)[^.!?]){0,100}third[- ]person|(?:偏好|喜歡|要求|希望)(?:(?!第一人稱)[^。！？]){0,100}第三人稱"
TRADITIONAL_CHINESE_NEGATIVE = r"\b(?:does\s+not|doesn't|do\s+not|don't)\s+(?:prefer|like|want|require)\b[^.!?]{0,120}traditional\s+chinese|(?:不偏好|不喜歡|不要|拒絕)[^。！？]{0,120}(?:繁體中文|正體中文)"
TRADITIONAL_CHINESE_POSITIVE = r"\b(?:prefers?|likes?|requires?|wants?)\b[^.!?]{0,160}traditional\s+chinese|(?:偏好|喜歡|要求|希望)[^。！？]{0,160}(?:繁體中文|正體中文)"

# Reviewed concepts: id, key, whether incomparable statements are equivalent, patterns that must all match, pattern
# that must not match, polarity rule. All but the first need an explicit preference.
CONCEPTS = (
    ("nancy_live_commentary_placement", "preference:user:story_stream_structure:nancy_live_commentary_placement", True, (), None, "placement"),
    ("generation_routing_8b", "preference:user:model_routing:generation:8b", True, (r"\b8b\b[\s\S]{0,100}(?:generation\s*(?:route|routing|路由)|生成(?:模型)?路由)|(?:generation\s*(?:route|routing|路由)|生成(?:模型)?路由)[\s\S]{0,100}\b8b\b",), None, "generic"),
    ("dark_mode", "preference:user:display:dark_mode", False, (r"dark\s+mode|深色模式|暗色模式",), None, "generic"),
    ("narrative_third_person_game_series", "preference:user:narrative:third_person:game_series", True, (r"third[- ]person|第三人稱", r"game|games|series|遊戲|系列"), None, "third_person"),
    ("notifications", "preference:user:notifications", False, (r"notifications?|通知",), None, "generic"),
    ("interaction_language_traditional_chinese", "preference:user:interaction_language:traditional_chinese", True, (r"traditional\s+chinese|繁體中文|正體中文", r"language|interact|communicat|response|reply|write|speak|語言|互動|溝通|回覆|回答|書寫|口語|使用"), None, "traditional_chinese"),
    ("narrative_third_person", "preference:user:narrative:third_person", True, (r"third[- ]person|第三人稱", r"story|stories|narrative|novel|writing|style|故事|小說|敘事|寫作|風格"), r"game|games|series|遊戲|系列", "third_person"),
    ("short_games_first", "preference:user:game_order:short_games_first", False, (r"short\s+games?|shorter\s+games?|短(?:篇)?遊戲", r"\b(?:first|before|prioriti\w*|start(?:ing)?\s+with)\b|先行|優先|先玩|開始"), None, "generic"),
)

# Limits.
SYNC_PAGE = 1000
OPERATIONS_PAGE = 200
CLAIM_LIMIT = 100
TOP_K_LIMIT = 100
MIN_INSIGHT_CONFIDENCE = 0.75

# What a user says that carries nothing to keep.
EPHEMERAL = r"^(?:你好|您好|嗨|哈囉|哈啰|早安|午安|晚安|謝謝|谢谢|感謝|感谢|多謝|多谢|好|好的|好啊|可以|可以啊|嗯|嗯嗯|收到|知道了|了解|明白|\/start|hi|hello|hey|thanks|thank\s+you|ok|okay|got\s+it|understood)\s*[。.!！?？~～]*$"
FIRST_CONTACT = (
    r"^(?:你好|您好|嗨|哈囉|哈啰)[，,\s]*(?:(?:我是|我叫)[^。.!！?？]{1,32}[。.!！?？]\s*)?(?:(?:今天是)?(?:我們|我们)?(?:的)?第一次(?:聊天|對話|对话)|初次(?:見面|见面))[，,。.!！?？\s]*(?:很高興|很高兴|很開心|很开心)(?:認識|认识|見到|见到)你[。.!！?？~～]*$",
    r"^(?:hi|hello|hey)[,!\.\s]*(?:(?:i\s+am|i'm|my\s+name\s+is)\s+[^.!?]{1,32}[.!?]\s*)?(?:(?:this\s+is\s+)?(?:our\s+)?first\s+(?:chat|conversation|time\s+(?:chatting|talking)))[,!\.\s]*nice\s+to\s+meet\s+you[.!?~]*$",
)
INJECTED = r"^\s*(?:<environment_context\b|<user_instructions\b|<developer\b|<system\b|<in-app-browser-context\b|#\s*AGENTS\.md\b|#\s*Developer\b|#\s*System\b)"
KEYWORDS = {
    "technical": ("debug", "error", "bug", "fix", "sqlite", "database", "postgres", "deploy", "除錯", "錯誤", "修復", "資料庫", "部署", "連線"),
    "project": ("project", "repo", "repository", "architecture", "handoff", "roadmap", "milestone", "專案", "架構", "開發", "交接", "邊界"),
    "preference": ("prefer", "preference", "rather than", "instead", "i like", "比較喜歡", "偏好", "不要", "改成", "以前", "現在", "更喜歡"),
    "inference": ("therefore", "this means", "it implies", "insight", "hypothesis", "therefore", "因此", "所以", "代表", "推論", "推測", "意味著", "應該", "結論"),
}
#: Characters of a session that keywords are looked for in.
KEYWORD_CHARS = 80_000
