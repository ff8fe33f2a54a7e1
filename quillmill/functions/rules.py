"""Rule tables: keywords, patterns and priorities. Operators take them as parameters; these are the defaults."""

# Topic tags from the most specific on, with their keywords.
TAGS = [
    ("转专业", ["转专业", "专业分流", "转学"]),
    ("创新学分", ["创新学分", "创新分", "学科竞赛"]),
    ("勤工助学", ["勤工助学", "助学岗位"]),
    ("综合测评", ["综合测评", "综测"]),
    ("英语课程", ["英语", "四六级", "免修", "重考"]),
    ("培养方案", ["培养方案", "教学计划", "课程设置", "毕业要求", "培养计划"]),
    ("奖学金", ["奖学金", "助学金", "励志", "评优"]),
    ("考试", ["考试", "补考", "重修", "缓考", "作弊", "违纪"]),
    ("学籍", ["学籍", "注册", "休学", "复学", "退学", "开除"]),
    ("选课", ["选课", "课程", "学分", "必修", "选修", "限选"]),
]
# Words that settle a tag wherever a text has them, in the same order.
MARKERS = [
    ("转专业", ["转专业", "专业分流"]),
    ("创新学分", ["创新学分", "创新分"]),
    ("勤工助学", ["勤工助学"]),
    ("综合测评", ["综合测评", "综测"]),
    ("培养方案", ["培养目标", "毕业要求", "培养计划", "培养方案", "主干学科"]),
    ("奖学金", ["奖学金", "助学金"]),
]
OTHER_TAG = "其他"
NO_YEAR = "(未标记)"

# Document types by words of the file name, then of the text.
PLAN, NOTICE, POLICY = "培养方案", "通知", "制度"
TYPE_BY_NAME = [
    (PLAN, ["培养计划", "培养方案"]),
    (NOTICE, ["通知", "说明", "指南", "举办", "招募", "命题", "补充", "申请操作"]),
    (POLICY, ["办法", "规定", "条例", "评定"]),
]
TYPE_BY_TEXT = [(PLAN, ["培养目标", "毕业要求", "主干学科"]), (NOTICE, ["特此通知", "现将有关事项通知"])]

# Scopes.
COLLEGE, CAMPUS, UNIVERSITY = "学院", "校区", "校级"
SCOPE_BY_NAME = [(COLLEGE, ["学院", "名额分布"]), (CAMPUS, ["屏峰", "朝晖", "莫干山"]), (UNIVERSITY, ["浙江工业大学", "浙工大"])]
SCOPE_BY_TEXT = [(COLLEGE, ["计算机学院", "软件学院"]), (UNIVERSITY, ["浙江工业大学"])]

# Terms that the tokenizer keeps whole.
TERMS = ["平均学分绩点", "综合测评", "创新学分", "勤工助学", "省政府奖学金", "限选", "通识选修", "专业必修", "专业选修", "公共基础", "培养方案", "毕业要求", "学分要求"]

# Signals of questions that boosts look for.
TOPIC_TIME = ["什么时候", "何时", "截止", "本学期", "这学期", "这学年", "几号", "多久", "时间范围", "报名", "日期"]
META_TIME = ["什么时候", "时间", "学期", "本学期", "这学年", "今年", "申请", "报名", "截止", "日期"]
META_SCOPE = [(COLLEGE, ["计算机学院", "软件学院", "计算机"]), (CAMPUS, ["屏峰", "朝晖", "莫干山"])]

# Subjects that the corpus does not cover, in the order of their checks.
OUT_OF_SCOPE = ["研究生", "硕士", "博士", "导师", "转专业", "辅修学位", "辅修专业", "毕业设计", "毕业论文", "开题", "答辩", "补考", "重修", "缓考", "宿舍", "住宿", "后勤", "社团", "学生会", "出国", "留学", "交换生"]
FALLBACK_ANSWER = "未在现行政策中找到依据，建议咨询教务处。"

# Value patterns by type, in the order of their checks.
VALUES = [
    ("gpa", r"(?:绩点|GPA)[^\d]*(\d+\.?\d*)"),
    ("percent_rank", r"前\s*(\d+)\s*%"),
    ("percent_max", r"不超过\s*(\d+)\s*%"),
    ("money", r"(\d+(?:\.\d+)?)\s*元(?!\s*每\s*小时)"),
    ("credit", r"(\d+(?:\.\d+)?)\s*学分"),
    ("people", r"(\d+)\s*人"),
    ("count", r"(\d+)\s*(?:个|道|题)"),
    ("score", r"(\d+\.?\d*)\s*分"),
    ("year", r"(?<!\d)(\d{4})\s*年"),
    ("date", r"(\d{1,2})\s*月\s*(\d{1,2})\s*日"),
    ("hourly_rate", r"(\d+(?:\.\d+)?)\s*元\s*每\s*小时"),
]
# Keywords of conditions, in the order of their checks.
CONDITIONS = ["不及格", "挂科", "处分", "违纪", "贫困认定", "有效期", "前三位", "第一作者", "自主上报", "带公章", "公示", "通过资格审核", r"前\d+%", r"不低于\s*\d+", r"不超过\s*\d+"]
# Majors and fields of credit claims, negations, and the ends of sentences.
MAJORS = "计算机科学与技术|软件工程|网络工程|数字媒体技术"
FIELDS = "第二课堂|专业必修|专业选修|学科基础|通识|实践教学|辅修|毕业|总学分"
GRADUATION, ALL_CREDITS = "毕业", "总学分"
NEGATION = "(?:并非|不是|不需要|不必|无需|无须|不用|不得|不能|没有|未曾|未|不|无)$"
SENTENCE_END = "[。；;！？!?\\n]"
CLAUSE_END = r"[，,](?!\s*(?:均为|同为|都是|均需|各为))"

# Classes of conditional wording, each with the patterns to count in a corpus.
PHRASES = [
    ("并列条件", r"须(?:同时)?符合以下条件"),
    ("并列条件", r"还须(?:同时)?符合"),
    ("并列条件", r"（\d+）.*；.*（\d+）"),
    ("并列条件", r"同时(?:具备|满足|符合)"),
    ("并列条件", r"且.*(?:同[时具]|均)"),
    ("阈值条件", r"不(?:低于|少于|超过|大于)\s*\d+"),
    ("阈值条件", r"前\s*\d+\s*%"),
    ("阈值条件", r"比例不超过\s*\d+\s*%"),
    ("阈值条件", r"不低于\s*\d+\.?\d*"),
    ("阈值条件", r"达到\s*\d+.*(?:分|含|以上)"),
    ("阈值条件", r"\d+\s*(?:分|元|学分).*?(?:以上|及以上|含)"),
    ("阈值条件", r"最多\s*(?:不超过|不超过)"),
    ("排除/取消条件", r"(?:取消|不具备).*(?:资格|条件)"),
    ("排除/取消条件", r"凡.*(?:违反|受到|处分)"),
    ("排除/取消条件", r"(?:无|没有).*?(?:不及格|处分|违纪)"),
    ("例外/特殊条件", r"(?:具体|特殊).*?(?:情况|条件|要求)"),
    ("例外/特殊条件", r"(?:除.*(?:外|以外))"),
    ("例外/特殊条件", r"以.*(?:为准|为据)"),
    ("时间限定", r"(?:上一|本|当)学年"),
    ("时间限定", r"每学年.*?(?:初|末|第.*学期)"),
    ("时间限定", r"(?:仅限|限于|仅在).*?(?:期间|内|前)"),
    ("时间限定", r"\d{4}\s*年.*?(?:至|到|-|—).*?\d{4}\s*年"),
    ("资格限定", r"(?:全日制|在校|普通).*?(?:本科|学生)"),
    ("资格限定", r"(?:面向|针对|适用于).*?(?:学生|专业|年级)"),
    ("资格限定", r"(?:须|需)(?:要)?(?:通过|完成|获得)"),
]

# Question and file forms of the direct lookup of total credits.
TOTAL_QUESTION = (
    r"^(?:请问)?(?:(20\d{2})(?:年级|级|年|版)?的?)?([一-鿿]+?)(?:专业)?的?毕业"
    r"(?:(?:总)?学分(?:要求)?(?:是|为|有)?(?:多少|几)(?:学分)?|(?:一共|总共|至少)?(?:需要|需|要|须)?(?:至少)?(?:修满|修够|修|达到)?(?:多少|几)学分)[？?。！!]*$"
)
PLAN_FILE = r"^(20\d{2})\s*(.+?)(?:专业)?培养(?:计划|方案)\.pdf$"
TOTAL_FIELD = r"毕业(?:总)?学分要求\s*[:：]\s*([0-9]+(?:\.[0-9]+)?)\s*学分"
