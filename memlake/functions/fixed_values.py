"""Fixed values that results must agree on: word lists, patterns and tables, plainly and in their natural order.

Patterns are for lower-case text in English and for the text as it is in Chinese and
Japanese. The word lists of the weakest tier are given in English; those of other
languages are a parameter (``classify.Words``).
"""

# Forms of credentials.
SECRETS = (
    ("openai_api_key", r"\bsk-[a-zA-Z0-9]{20,}\b"),
    ("github_token", r"\bghp_[a-zA-Z0-9]{36}\b"),
    ("github_oauth", r"\bgho_[a-zA-Z0-9]{36}\b"),
    ("github_app", r"\bghs_[a-zA-Z0-9]{36}\b"),
    ("github_refresh", r"\bghr_[a-zA-Z0-9]{36}\b"),
    ("anthropic_key", r"\bsk-ant-[a-zA-Z0-9\-]{20,}\b"),
    ("aws_access_key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("aws_secret_key", r"(?i)aws_secret_access_key\s*[=:]\s*\S+"),
    ("google_api_key", r"\bAIza[a-zA-Z0-9\-_]{35}\b"),
    ("stripe_secret_key", r"\bsk_live_[a-zA-Z0-9]{24,}\b"),
    ("stripe_publishable_key", r"\bpk_live_[a-zA-Z0-9]{24,}\b"),
    ("slack_bot_token", r"\bxoxb-[a-zA-Z0-9\-]{10,}\b"),
    ("slack_user_token", r"\bxoxp-[a-zA-Z0-9\-]{10,}\b"),
    ("sendgrid_key", r"\bSG\.[a-zA-Z0-9\-_]{22,}\.[a-zA-Z0-9\-_]{43,}\b"),
    ("generic_api_key", r"""(?i)(?:api[_-]?key|apikey)\s*[=:]\s*["']?[a-zA-Z0-9\-_]{20,}["']?"""),
    ("password_assignment", r"""(?i)(?:password|passwd|pwd)\s*(?:=|:)\s*["']?[^\s"']{4,}["']?"""),
    ("password_in_url", r"://[^/\s:]+:[^/\s@]+@"),
    ("bearer_token", r"(?i)bearer\s+[a-zA-Z0-9\-_.~+/]+=*"),
    ("jwt_token", r"\beyJ[a-zA-Z0-9\-_.~+/]+=*\.eyJ[a-zA-Z0-9\-_.~+/]+=*\.[a-zA-Z0-9\-_.~+/]+=*"),
    ("generic_token", r"""(?i)(?:token|access_token|refresh_token|auth_token)\s*[=:]\s*["']?[a-zA-Z0-9\-_.~+/]{20,}["']?"""),
    ("private_key", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----"),
    ("db_connection_string", r"(?i)(?:mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^\s]+"),
    ("db_connection_string_with_creds", r"(?i)(?:mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^/\s:]+:[^/\s@]+@[^\s]+"),
    ("generic_secret", r"""(?i)(?:secret|credential|private_key)\s*[=:]\s*["']?[a-zA-Z0-9\-_.~+/]{20,}["']?"""),
    ("env_sensitive", r"""(?i)(?:SECRET_KEY|PRIVATE_KEY|ENCRYPTION_KEY|AUTH_SECRET)\s*=\s*["']?[^\s"']{8,}["']?"""),
)

# Time words of a query, the days they reach back (if any), whether they ask for the oldest first.
TIME_EXPRESSIONS = (
    (r"\b(recently|lately|just)\b", 7, False),
    (r"\b(this\s+week|past\s+week|last\s+week)\b", 7, False),
    (r"\b(this\s+month|past\s+month|last\s+month)\b", 30, False),
    (r"\b(recent|latest|newest|current)\b", 14, False),
    (r"\b(today|yesterday)\b", 2, False),
    (r"\b(first|initial|earliest|original)\b", None, True),
    (r"\b(before|prior\s+to|earlier)\b", None, False),
    (r"\b(after|since|following)\b", None, False),
    (r"\b(last\s+year|previous\s+year)\b", 365, False),
    (r"\b(\d+)\s+(days?|weeks?|months?)\s+ago\b", None, False),
)

# Messages that hold nothing to remember, by kind and language.
ACKNOWLEDGMENT = {
    "en": (
        r"^ok\.?$", r"^okay\.?$", r"^o\.k\.?$", r"^oki\.?$", r"^sure\.?$", r"^yes\.?$", r"^yeah\.?$", r"^yep\.?$", r"^ya$", r"^got\s+it\.?$", r"^gotcha\.?$", r"^alright\.?$", r"^alrighty\.?$",
        r"^understood\.?$", r"^noted\.?$", r"^roger\s+that\.?$", r"^copy\s+that\.?$", r"^thanks?\.?$", r"^thank\s+you\.?$", r"^thx\.?$", r"^ty\.?$", r"^appreciate\s+it\.?$",
        r"^sounds?\s+(good|great)\.?$", r"^alright,?\s+makes?\s+sense\.?$", r"^noted,?\s+thanks?.*$", r"^got\s+it,?.*\s+handle", r"^(ok|okay|sure|alright|got\s+it)[,\s]+",
    ),
    "zh": (r"^好的[。.]?$", r"^嗯[。.]?$", r"^行[。.]?$", r"^对[。.]?$", r"^收到[。.]?$", r"^明白[。.]?$", r"^知道了[。.]?$", r"^没问题[。.]?$", r"^可以[。.]?$", r"^谢谢[。.]?$"),
    "ja": (r"^はい[。.]?$", r"^いいえ[。.]?$", r"^わかりました[。.]?$", r"^了解[。.]?$", r"^ありがとう[。.]?$", r"^OK[。.]?$", r"^なるほど[。.]?$", r"^そうですね[。.]?$"),
}
CHITCHAT = {
    "en": (
        r"^hi$", r"^hello$", r"^hey$", r"^howdy$", r"^nice\s+(weather|day|to\s+meet\s+you)\.?", r"^(it'?s\s+)?(raining|sunny|cloudy|hot|cold|warm|snowing).*$", r"^(too\s+)?(hot|cold|warm|humid)\s+today\.?",
        r"^(how\s+was\s+your\s+(weekend|day|night))\??$", r"^(did\s+you\s+(watch|see|try).*)\??$", r"^(happy\s+birthday|congrats|congratulations)", r"^(have\s+you\s+tried|seen)\s+(that|this|the)\s+.*\??$",
        r"^(see\s+you|talk\s+later|goodbye|bye|take\s+care)\.?$", r"^(interesting|\.\.\.|hmm|oh\s+really|is\s+that\s+so|cool)[\s!]*$", r"^what\s+a\s+(beautiful|lovely|nice|great)\s+(day|morning|evening)",
        r"^hmm[,\.]?\s+let\s+me\s+think", r"^let\s+me\s+think\s*(about\s+it)?$",
    ),
    "zh": (r"^你好[！!？?]?$", r"^嗨[！!？?]?$", r"^早上好[！!]?$", r"^下午好[！!]?$", r"^再见[！!]?$", r"^回头见[！!]?$"),
    "ja": (r"^こんにちは[！!？]?$", r"^おはよう[！!？]?$", r"^さようなら[！!？]?$", r"^またね[！!？]?$"),
}
LOG_LINE = (r"^\[(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL)\]", r"^(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL)[:\s]")
COMMAND = (
    r"^(npm|pip|conda|cargo|go|gradle|maven|docker|kubectl|git|make|cmake)\s+",
    r"^(cd |ls |cat |echo |rm |cp |mv |mkdir |touch |chmod |chown |grep |find |wget |curl )",
    r"^(python|node|java|ruby|php|bash|sh|zsh|fish)\s+",
)
FACT_INDICATOR = (r"\d+(\.\d+)", r"\b(is|are|was|were|has|have)\s+", r"\b(supports?|requires?|provides?|includes?)\s+")
QUESTION = {
    "en": (r"^(how|what|when|where|why|who|which|can|could|would|is|are|do|does|did)\s+", r"^what'?s\s+", r"^who'?s\s+", r"^where'?s\s+", r"^how'?s\s+"),
    "zh": (r"^(怎么|如何|为什么|什么|哪里|谁|多少|是不是|能不能|可以吗)",),
    "ja": (r"^(どう|なぜ|何|どこ|誰|いくら|どうやって)",),
}
INSTRUCTION = (
    r"^(please\s+)?(run|execute|start|launch|deploy|build|test|check|verify)\s+",
    r"^(create|open|send|write|generate|download|install|update|delete|remove)\s+",
    r"^(can\s+you\s+)?(help\s+me\s+)?(show|tell|give|explain|find|search)\s+",
)
WORKFLOW_WORD = (r"\bevery\b", r"\balways\b", r"\bbefore\b", r"\bafter\b", r"\bweekly\b", r"\bmonthly\b", r"\bdaily\b", r"\beach\b")
ADVERSARIAL = (
    r"\bdon'?t\s+remember\s+(this|it|me)\b", r"\bnot\s+(a\s+)?memory\b", r"\bjust\s+a\s+test\b", r"\bpretend\s+this\s+is\b", r"\bignore\s+(this|the\s+above)\b", r"\bdefinitely\s+not\s+worth\b",
    r"\bdo\s+not\s+(store|save|remember)\b", r"\bthis\s+is\s+(just\s+)?(a\s+)?(test|fake|random)\b",
)
# Words that make a command or instruction a statement.
SUBSTANCE = (
    "docker", "kubernetes", "agile", "methodology", "containerization", "microservices", "devops", "ci/cd", "continuous", "integration", "deployment", "monitoring", "observability", "architecture", "framework",
    "library", "runtime", "compiler", "database", "serverless", "cloud", "infrastructure", "pipeline", "orchestration", "prometheus", "grafana", "elasticsearch", "redis", "nginx", "python", "javascript",
    "typescript", "golang", "rust", "java",
)

# Patterns of the detectors, by tier and language.
CORRECTION_EXPLICIT = {
    "en": (
        r"^correction\s*:", r"^correction$", r"\bscratch\s+that\b", r"\bforget\s+(about|what|i)\s+(i\s+)?(said|told you)\b", r"\bignore\s+(what|i)\s+(said|told|mentioned)\b", r"\bnever\s+mind\b",
        r"\blet\s+me\s+(rephrase|redo|refine|correct|clarify)\b", r"\bi\s+(take\s+that\s+back|didn't\s+mean\s+that)\b", r"\bforget\s+about\b.*\b(instead|rather|better|use|go\s+with)\b",
    ),
    "zh": (r"^纠正[：:]", r"^纠正一下", r"^更正[：:]", r"我之前说错了", r"之前说的不对", r"忽略之前说的", r"忘掉之前说的", r"不是这样的", r"不对[，,]应该", r"错了[，,]应该是", r"不对不对", r"那个不对", r"方法错了", r"配置有错", r"之前说的忽略", r"上个想法作废"),
    "ja": (r"^訂正[：:]", r"^訂正します", r"^修正[：:]", r"前に言ったのは間違い", r"前の発言は無視", r"いやいや", r"それは違います", r"間違ったアプローチ", r"設定にエラー", r"前の数字は間違って"),
}
CORRECTION_STRUCTURAL = {
    "en": (
        r"^(?:no[,\.]?|not\s+|wait[,\.]?\s+|hold\s+on)",
        r"(?:that's|it's|this\s+is)\s+(?:all\s+wrong|wrong|incorrect|not\s+right|not\s+correct|mistaken)",
        r"^(?:actually|in\s+fact|let\s+me\s+clarify|to\s+be\s+clear|let\s+me\s+be\s+clear)[,\s:]",
        r"\bactually\s+(is|was)\b",
        r"\bis\s+actually\b",
        r"(?:use|try|go\s+with|switch\s+to|change\s+to)\s+(?:this|that|the)\s+(?:one|instead|approach|way|method)",
        r"(?:undo|revert|rollback|cancel|discard|scrap|remove)\s+(?:that|this|the|it)\s",
        r"(?:\w+\s+is\s+better|prefer\s+\w+\s+instead|rather\s+(?:have|use|go)\s+with)\b.*\b(?:than|over|instead\s+of)\b",
        r"(?:there'?s?\s+an?\s+|(?:i\s+)?made\s+a\s+)(?:error|mistake|bug|issue|problem|typo).*\bfix\b",
        r"\bnot\s+.+,\s*(?:but\s+)?(instead|rather|use|try)\b",
        r"^(?:nope|no)[,.\s]+(that|it|this)\s+(?:'?s\s+)?(not\s+)?(right|correct|wrong|what\s+i\s+meant)",
    ),
    "zh": (r"不对[，,]?", r"错了[，,]?", r"不是.*而是", r"应该是.*不是", r"其实.*决定", r"我澄清一下", r"等等.*不是那个意思", r"回退到.*方案", r"不是.*用.*才对"),
    "ja": (r"いや[、,]?", r"間違って", r"実は.*に決め", r"確認しますが", r"正しくありません", r"前のアプローチに戻"),
}
CORRECTION_WORDS = ("wrong", "incorrect", "mistake", "error", "fix it", "bug in", "change our", "change strategy", "different approach", "should be", "needs to be", "actually is", "supposed to be")
PREFERENCE_STRONG = {
    "en": (
        r"\b(i\s+)?(prefer|preference|favor|favour|rather)\b.*\b(over|instead of|to|than|rather than)\b",
        r"\b(use|using|utilizing|adopting|choosing|picking|going with)\b.*\b(over|instead of|rather than|not)\b",
        r"^(i\s+)?(always|never|generally|typically|usually|normally|consistently)\s+(use|prefer|like|love|hate|avoid|stick to|go for)\b",
        r"\b(my\s+)?(default|standard|convention|practice|habit|rule|policy|preference|style|choice|approach|way)\s+(is|are|will be|has been|should be)\b",
        r"\b(when|while|whenever|if)\s+(writing|coding|developing|building|working)\s+\w+,\s*i\s+(always|usually|prefer|like|tend to)\b",
        r"\b(for|in|on|during)\s+\w+.*(i\s+)?(prefer|use|choose|pick|like|stick to|go with)\b",
        r"\b(i\s+)?(really\s+)?(like|love|enjoy|appreciate|admire|adore|hate|dislike|can't stand|despise|loathe)\b",
        r"\b(big\s+)?(fan\s+of|supporter of|advocate for|pro-|anti-)\b",
    ),
    "zh": (r"我(喜欢|偏好|偏爱|倾向于|习惯|爱|讨厌|不喜欢)", r"(别用|不要用|避免)", r"(总是|从不|通常|一般)", r"我的(默认|标准|风格|习惯|选择)", r"我喜欢用", r"我不喜欢"),
    "ja": (r"(好き|嫌い|好む|欲しい)", r"(いつも|常に|通常|習慣的に)", r"(使いたい|使ってください|お願い)", r"(避けて|使わず)", r"(デフォルト|標準|スタイル|選択)"),
}
PREFERENCE_WORDS = (
    "like", "prefer", "love", "hate", "want", "dislike", "preference", "favorite", "favourite", "preferred", "adore", "default", "standard", "convention", "style", "approach", "choice", "habit", "practice", "routine",
    "ritual", "rule", "policy", "always", "never", "usually", "typically", "normally", "consistently", "over", "instead of", "rather than", "better than", "worse than",
)
DECISION_STRONG = {
    "en": (
        r"\b(decision|decided?|choose|chose|chosen|choice|select|selected|selection|pick|picked)\b",
        r"\b(going\s+with|settled?\s+on|opted?\s+for|landed?\s+on|went\s+with)\b",
        r"\b(adopt|adopting|adopted|embrace|embraced)\b",
        r"\b(agreed?|consensus|unanimous|commit(ted|ting)?|pledge(d|ing)?)\b",
        r"\b(final(ize|ized|ization)|confirm(ed|ation)|approve(d|val)?|sign(ed|ing|off)?)\b",
        r"\b(architecture|approach|strategy|plan|pattern|design|solution|stack|framework|library|tool|tech|technology)\s+(is|will be|should be|has been|we('re| are))\b",
        r"\b(use|using|utilizing|leveraging)\s+\w+\s+(instead\s+of|over|rather\s+than)\b",
        r"^use\s+\w+\s+(for|in|as|to)\s+\w+",
        r"\b(we|team|group)\s+('ll|will|are|'re)\s+(use|using|adopt|adopting|go\s+with|move\s+to|switch\s+to|build\s+with|deploy\s+(with|on|to))\b",
        r"\bagreed?\s+to\s+(use|adopt|go\s+with|switch\s+to|implement|build|deploy)\b",
        r"\bdecided?\s+to\s+(use|adopt|go\s+with|switch\s+to|migrate|move|build|deploy|implement)\b",
        r"\b(from\s+now\s+on|going\s+forward|henceforth)\b",
        r"\b(are|is|will be)\s+(mandatory|required|standard|policy|rule|practice|norm|convention|default)\b",
    ),
    "zh": (r"我们(用|采用|选了|决定用)", r"(决定|确定|选定)", r"(方案|策略|架构)", r"团队(同意|采用)"),
    "ja": (r"(使いましょう|行きましょう|に決めました|選びました)", r"(採用|決定|選択)", r"(チーム|合意)"),
}
DECISION_WEAK = ("let's use", "let's go with", "let's adopt", "let's choose", "we should use", "we could use", "we might use", "i think we should", "i propose we", "i suggest we", "best option is", "better to go", "makes sense to", "our approach", "the plan is", "the strategy is")
DECISION_WORDS = ("decide", "determine", "conclude", "resolve", "finalize", "preference", "verdict", "ruling", "judgment")
DECISION_GUARD = r"\b(decided?|agreed?|chose|chosen|going\s+with|settled?\s+on|opted?\s+for|we\s+('ll|will)\s+(use|adopt|go\s+with|move\s+to|switch\s+to))\b"
TASK_STRUCTURED = (
    r"^(i\s+|we\s+|let's\s+)?(need|should|must|have|got)\s+to\s+", r"^(todo|task):\s*", r"^(please\s+)?(can\s+you\s+)?(help\s+me\s+)?(implement|refactor|fix|add|create|build|write|update)\s+",
    r"^(don('t)?\s+)?forget\s+to\s+", r"^(remember\s+to\s+|make sure to\s+)", r"^(we're|we are|i'm|i am)\s+(going to|planning to|working on)\s+",
)
TASK_WORKFLOW = (
    r"^(always|every\s+time|each\s+time|generally|typically|normally|usually)\s+(run|test|review|check|verify|update|backup|deploy|build|lint|format|document|validate)\b",
    r"\b(run|test|review|check|verify|update|backup|deploy|build|lint|format|document|validate|monitor|analyze|debug|refactor|optimize|migrate|integrate)\b\s+(always|every\s+\w+|weekly|monthly|daily|before\s+\w+|after\s+\w+|each\s+\w+|on\s+\w+days?|at\s+\w+)\b",
    r"^(weekly|monthly|daily|quarterly|annually|yearly)\s+.*\b(retro|meeting|report|sync|standup|review|check|update|deploy|release|backup)\b",
    r"\b(every\s+(morning|afternoon|evening|night|monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month|quarter|year))\b.*\b(i\s+|we\s+)?(check|review|run|test|update|verify|monitor|analyze|send|generate|create|build|deploy)\b",
    r"^(before|after|when|whenever|once)\s+\w+.*,?\s*(please\s+)?(make sure to|remember to|don't forget to|ensure to|verify|check|test|update|run|review)\b",
    r"\b(before|after)\s+(every|each|any|all)\s+\w+.*(run|test|check|review|update|verify|deploy|backup|build)\b",
)
TASK_HABIT = (
    r"^(i|we)\s+(always|usually|typically|normally|generally|tend to|like to|try to)\s+(check|review|run|test|update|verify|monitor|read|write|build|deploy|start|begin|finish|complete|do)\b",
    r"^(my|our)\s+(routine|habit|practice|workflow|process|schedule|ritual|rule|policy|guideline|standard|procedure)\s+(is|includes|requires|involves|has)\b",
)
TASK_WORDS = (
    "implement", "refactor", "optimize", "fix", "debug", "resolve", "add", "create", "build", "make", "generate", "develop", "write", "update", "upgrade", "migrate", "integrate", "deploy", "release", "plan", "design",
    "architect", "research", "investigate", "analyze", "review", "test", "validate", "verify", "check", "monitor", "need to", "should", "must", "have to", "require", "going to", "todo", "task", "action item",
    "follow up", "next step",
)
RELATIONSHIP = {
    "en": (
        r"^(\w+)\s+(?:owns?|leads?|manages?|heads?|runs?)\s+(?:the\s+)?(.+)", r"(\w+)\s+(?:is|was)\s+(?:our|the|my)\s+(dba|pm|lead|architect|owner|maintainer|contact|expert|specialist)",
        r"(\w+)\s+(?:does|handles?|takes?\s+care\s+of|works?\s+on)\s+(.+)", r"(\w+)\s+(?:reports?\s+to|answers?\s+to)\s+(\w+)", r"(\w+)\s+(?:is\s+(?:on|in)|belongs?\s+to)\s+(?:the\s+)?(.+)\s+team",
        r"(?:ask|contact|reach(?:\s+out)?\s+to)\s+(\w+)\s+(?:about|for|regarding)", r"(.+)\s+(?:depends?\s+on|relies?\s+on|uses?|imports?|calls?|invokes?)\s+(.+)",
        r"(.+)\s+(?:which|that)\s+(?:routes?\s+to|calls?|triggers?|publishes?\s+events?\s+(?:to|that))\s+(.+)", r"(.+)\s+(?:subscribes?\s+to|listens?\s+to|consumes?|reads?\s+from)\s+(.+)",
        r"(.+)\s+(?:sits?\s+between|connects?\s+|bridges?|links?)\s+(.+)", r"(.+)\s+(?:triggers?\s+after|runs?\s+after|starts?\s+when|fires?\s+on)\s+(.+)",
        r"(.+)\s+(?:pushes?\s+to|deploys?\s+to|merges?\s+into|integrates?\s+with)\s+(.+)", r"(.+)→(.+)", r"(.+)\s+->\s*(.+)",
    ),
    "zh": (r"(.+)(负责|管理|处理|担当)(.+)", r"(.+)(是|在)(.+)(团队|组)", r"(我的|我们的)(经理|同事|队友|领导)", r"(.+)(和|与)(.+)(一起|合作)"),
    "ja": (r"(.+)(が|は)(.+)(を)?(担当|管理|処理)", r"(.+)(の)(マネージャー|リード|担当者)", r"(マネージャー|リード|担当者)(の)(.+)", r"(.+)(と)(.+)(一緒に|協力)"),
}
SENTIMENT = {
    "en": (
        r"^(?:i\s+)?(?:'?m|am|was|feel|feeling|get|getting)\s+(?:so\s+|really\s+|very\s+|super\s+)?(?:happy|excited|proud|grateful|thrilled|delighted|relieved|impressed|sad|angry|upset|frustrated|annoyed|worried|scared|exhausted|tired|bored|disappointed|confused|overwhelmed|stressed)\b",
        r"\b(?:i\s+)?(?:love|hate|loathe|detest|enjoy|appreciate|dislike|dread)\s+(?:it|this|that|the\s+\w+)",
        r"^(?:this|the)\s+.+\s+is\s+(?:so\s+|really\s+|absolutely\s+|incredibly\s+)?(?:great|awesome|amazing|fantastic|wonderful|terrible|awful|horrible|frustrating|annoying|beautiful)",
        r"\b(amazing|brilliant|outstanding|superb|marvelous|incredible|fantastic)\s+(work|job|effort|team|result|achievement)!",
        r"^\w+\s+work\b.*\b(?:on|for|with)\b",
    ),
    "zh": (r"(太|真|好|非常|特别)(棒|好|差|烂|烦|慢|快|美|糟糕|赞|牛)(了|！|!)?", r"(很|非常|特别)(开心|难过|生气|满意|失望|焦虑|担心|害怕)", r".*(烦|崩溃|心碎|无语|郁闷|不爽|焦虑|太棒)"),
    "ja": (r"(とても|すごく|本当に|めちゃくちゃ)(嬉しい|悲しい|楽しい|つまらない|怖い|不安|心配)", r".*(イライラ|ストレス|疲れた|うんざり|残念)", r"(素晴らしい|最高|ひどい|最悪|すごい|やばい)"),
}
SENTIMENT_ADJECTIVE = (
    r"\b(happy|sad|angry|frustrated|annoyed|excited|tired|exhausted|bored|worried|proud|glad|upset)\b", r"\b(great|good|bad|terrible|awful|nice|cool|lovely|horrible|amazing|fantastic|beautiful)\b",
)
INTENSIFIER = ("so ", "really ", "very ", "super ", "absolutely ", "extremely ")
SENTIMENT_WORDS = (
    "love", "hate", "dislike", "enjoy", "happy", "sad", "angry", "excited", "frustrated", "upset", "annoyed", "bored", "tired", "exhausted", "inspired", "proud", "confident", "worried", "scared", "relaxed", "loathe",
    "detest", "disappoint", "delighted", "thrilled", "depressed", "irritated", "panic", "frighten", "motivated", "too slow", "too fast", "too hard", "too easy", "painful", "annoying", "clunky", "laggy", "awesome",
    "fantastic", "wonderful", "amazing", "terrible", "horrible", "awful", "brilliant", "superb", "outstanding",
)
SENTIMENT_EXCLUSION = (
    r"\b(api|sdk|http|sql|python|java|docker|kubernetes|aws|redis|nginx)\b", r"\b(postgresql|mysql|mongodb|sqlite|supabase|firebase)\b", r"\d+(\.\d+)+", r"\b(v?\d+\.\d+)\b",
    r"\b(is|are|was|were|has|have)\s+(the\s+)?(?:minimum|required|default|located|hosted|running|deployed|based)\b", r"\b(runs?|operates?|works?)\s+(on|in|at|with|using|via)\b",
    r"\b(supports?|provides?|includes?|requires?|needs?|uses?)\s+\b", r"\b(server|database|endpoint|port|config|version|limit|service)\b",
)
FACT_NOISE = ("ok", "yeah", "sure", "thanks", "nice", "cool", "great", "got it", "sounds good", "alright", "understood", "noted", "interesting", "hmm", "oh really", "pretty")
FACT_STATEMENT = {
    "zh": (r"(.+)是(.+)", r"(.+)有(.+)", r"(.+)在做(.+)", r"(.+)属于(.+)", r"(.+)位于(.+)"),
    "ja": (r"(.+)(は|が)(.+)(です|である|します|あります)", r"(.+)(に)(あります|あります|あります)", r"(.+)(の)(要件|バージョン|仕様|制限)"),
}
FACT_TERM = (
    r"\b(api|sdk|http|https|tcp|udp|ip|dns|sql|nosql|graphql|rest|grpc|json|xml|csv)\b", r"\b(python|javascript|typescript|java|kotlin|go|rust|c\+\+|ruby|php|bash|shell)\b",
    r"\b(postgresql|mysql|mongodb|redis|elasticsearch|dynamodb|sqlite|supabase|firebase)\b", r"\b(docker|kubernetes|aws|gcp|azure|linux|nginx|git|github|ci|cd)\b",
    r"\b(llm|gpt|claude|gemini|llama|rag|vector|embedding|pytorch|tensorflow|mcp)\b", r"\b(oauth|jwt|encryption|2fa|mfa|rbac|sso|ssl|tls|api\s+key)\b",
    r"\b(instance|namespace|agile|methodology|containerization|microservices|serverless|orchestration|deployment|monitoring|observability|infrastructure|pipeline|scrum|devops|database|connection)\b",
    r"\benvironment\s+variables?\b", r"\b[a-z]+_[a-z]+\b", r"\d+(\.\d+)+", r"\d{4}[-/]\d{2}", r"\b(v?\d+\.\d+)\b",
)
FACT_TERM_STRUCTURE = (
    r"(.+)\s+(?:is|are|was|were|runs?|operates?)\s+(?:the\s+)?(?:minimum|required|default|located|hosted|running|deployed|based)", r"(.+)\s+(?:runs?|operates?|works?)\s+(?:on|in|at|with|using|via)\s+(.+)",
    r"(.+)\s+(?:supports?|provides?|includes?|contains?|features?)\s+(.+)", r"(.+)\s+(?:requires?|needs?|uses?|utilizes?)\s+(.+)",
    r"(?:the|our|my|this)\s+(?:api|database|server|system|service|app|endpoint|port|limit|version|config)\s+.+(?:is|are|=)", r"\b\d+\s*(?:employees?|users?|members?|people|teams?|instances?|pods?)\b",
    r"(.+)\s+(?:is|are|has|was|were)\s+(.+)", r"(.+)\s+(?:status)\s+\d+\s+(?:is|means|for)\s+(.+)", r"(.+)\s+(?:handshake)\s+(?:requires?|needs?|involves?)\s+(.+)", r"(.+)\s+(?:share[s]?\s+a)\s+(.+)", r"(.+)\s+(?:by\s+default)\b",
)
FACT_QUANTITY = (
    r"\b\d+\s*(?:%|percent|mb|gb|tb|ms|sec|min|hour|day|week|month|year|am|pm|jst|utc)\b", r"\b\d+[.,]?\d*\s*(?:employees?|users?|members?|people|teams?|servers?|nodes?|pods?)\b",
    r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)s?\b", r"\b\d{1,2}(?:am|pm|:)\b", r"\b(?:shanghai|beijing|tokyo|london|singapore|seoul|bangalore|berlin)\b",
    r"\bus-east-\d|us-west-\d|ap-southeast-\d|eu-west-\d\b", r"\$[\d,]+|\d+\s*k\s*\$|\$\d+k\b", r"\bv\d+[\.\w]*\b", r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b",
)
FACT_QUANTITY_STRUCTURE = (
    r"(.+)\s+(?:is|are|has|have|was|were)\s+(.+)", r"(.+)\s+(?:ends?|starts?|runs?|lasts?)\s+(?:on|at|in|by|every|each)\s*(.+)?", r"(?:my|our|the|this)\s+(?:office|work|team|standup|sync|meeting|budget|approval)\s+.+",
    r".*\b(?:hours?|schedule|time|deadline|budget|limit|rate|cost|price|version)\b.*",
    r"^(?:i|we|my|our)\s+.+\s+(?:got|had|went|took|bought|visited|attended|started|finished|completed|moved|joined|left|received|found|built|created)\b",
)
FACT_GENERAL = (
    r"^(?:we|i|our|my|the|this)\s+.+\s+(?:is|are|has|have|supports?|uses?|runs?|requires?)\s+.+", r".+\s+(?:live[s]?\s+in|work[s]?\s+(?:for|at|on|with)|based?\s+(?:in|on|at)|located?\s+(?:in|at))\s+.+",
    r"^(?:i|we)\s+(?:got|had|went|took|bought|visited|attended|started|finished|completed|moved|joined|left|received|found|built|created|gave|sent|called|met|saw|heard|read|wrote|drove|flew|stayed|lived|worked|studied|played|watched|ate|drank|cooked|cleaned|fixed|repaired|broke|lost|kept|sold|brought|put|set|turned|made|ran|fell|grew|became|felt|thought|knew|believed|decided|chose|preferred|loved|hated|enjoyed|avoided|tried|wanted|needed|learned|discovered|realized|remembered|forgot)\b",
)
LOCATION_EXCLUSION = (
    r"\b(is|are|was|were|has|have)\s+", r"\b(supports?|requires?|provides?|includes?)\s+", r"\b(every|always|weekly|monthly|daily)\b", r"\b(approval|budget|deadline|schedule|sprint)\b", r"\d+(\.\d+)+",
    r"\b(employees?|users?|members?|teams?)\s+\d+", r"\b(we\s+have|our\s+\w+)\s+", r"\b(runs?|operates?|works?)\s+(on|in|at)\s+", r"\b(latency|throughput|performance|uptime)\b",
    r"\b(live[s]?\s+in|work[s]?\s+(for|at|remotely))\b", r"\b(stands?|meets?|sync)\s+", r"\b(ends?|starts?|begins?)\s+(on|at)\s+", r"\b\d+\s*(employees?|users?|ms|sec|min|hour)\b",
)
LOCATION_WORDS = {"en": ("at", "in", "on", "located", "place", "location", "address"), "zh": ("在", "位于", "地址", "地方", "位置")}
PLACE_WORDS = {"en": ("park", "station", "airport", "hotel", "restaurant", "office", "building", "street", "avenue", "road"), "zh": ("公园", "车站", "机场", "酒店", "餐厅", "办公室", "大楼", "街道", "大道", "路")}
TYPE_ORDER = ("correction", "decision", "user_preference", "task_pattern", "fact_declaration", "sentiment_marker", "relationship", "location")
CHITCHAT_WORDS = (
    "sunny", "rainy", "weather", "beautiful day", "pretty", "sounds good", "oh really", "interesting", "hmm", "cool", "see you", "okay", "ok then", "alright", "sure thing", "😎", "😊", "👍", "🎉", "❤️", "💪", "🔥",
    "really?", "right?", "yes?", "no?",
)
