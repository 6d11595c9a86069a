"""Words and patterns whose values the results depend on."""

from __future__ import annotations

# Section labels, by section.
SECTION_LABELS = {
    "summary": ["summary", "profile", "professional summary", "个人概览", "个人简介", "职业概览", "自我评价"],
    "experience": ["experience", "work experience", "professional experience", "employment history", "工作经历", "工作经验", "职业经历", "实习经历"],
    "projects": ["projects", "selected projects", "project experience", "项目经历", "项目经验", "精选项目"],
    "education": ["education", "education background", "academic background", "教育背景", "教育经历", "学历"],
    "skills": ["skills", "technical skills", "professional skills", "专业能力", "专业技能", "技能"],
    "certifications": ["certifications", "certificates", "资格证书", "证书", "专业资格"],
}
SECTION_OF = {label: section for section, labels in SECTION_LABELS.items() for label in labels}

# Section titles, Chinese and English.
SECTION_TITLES = {
    "summary": ("个人概览", "Summary"),
    "experience": ("工作经历", "Experience"),
    "projects": ("精选项目", "Selected Projects"),
    "education": ("教育背景", "Education"),
    "skills": ("专业能力", "Skills"),
    "certifications": ("专业资格", "Certifications"),
}
UNCLASSIFIED_TITLES = ("原文待归类", "Source Content to Classify")
CONFLICT_TITLES = ("冲突候选原文", "Conflicting Source Candidates")

# Contacts. Written for engines whose \b is Unicode-aware and case-insensitive matching is asked for.
EMAIL = r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b"
URL = r"\b(?:https?://|www\.)\S+|\b(?:github\.com|linkedin\.com)/\S+|\b[a-z0-9][a-z0-9.\-]*\.[a-z]{2,}/\S+"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .\-]?)?(?:\(?\d{3}\)?[ .\-]?)?\d{3}[ .\-]\d{4}(?!\d)|(?<!\d)1[3-9]\d{9}(?!\d)"

# Names.
NAME_LABEL = r"(?:name|姓名)\s*[:：]\s*(.+)"
NOT_A_NAME = r"resume|curriculum|vitae|engineer|manager|developer|designer|analyst|candidate profile|求职|简历|经理|工程师|设计师|毕业|大学|公司|学院|产品|运营|研究员"
CJK_NAME = "[\u4e00-\u9fff]{2,6}"
LATIN_NAME_WORD = r"[A-Z][A-Za-z’'\-]*"

# Headings outside the known sections.
EXTRA_HEADING = r"(?:Other |Additional )?(?:Awards(?:\s+(?:and|&)\s+Honou?rs)?|Honou?rs(?:\s+(?:and|&)\s+Awards)?|Publications|Interests|Languages|References|Activities|Notes|Original Notes|Volunteer Activities)|其他说明|其他信息|获奖经历|兴趣爱好|志愿经历|学术成果|发表论文"

# Dates and bullets.
DATE_ATOM = r"(?:(?:19|20)\d{2}(?:[./\-]\d{1,2}|年\d{1,2}月)?年?|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+(?:19|20)\d{2})"
DATE_SPAN = "(" + DATE_ATOM + r")\s*(?:[-–—~至到]|\bto\b)\s*(" + DATE_ATOM + "|present|now|至今)"
DATE_CUE = r"\b(?:from|during|between|in|over)\s*$"
DATE_CUE_ZH_BEFORE = r"(?:在|于|从|自)\s*$"
DATE_CUE_ZH_AFTER = r"^\s*(?:期间|年间|内)"
BULLET = r"^\s*(?:-(?!\d|\.\d|[$€£¥]\s*(?:\d|\.\d))\s*|[*•●▪◦‣]\s*|\d+[.)、]\s+)(.+)$"
DATED_SECTIONS = ("experience", "projects", "education")
FLOW_FIELDS = ("part", "region", "page", "column", "table", "textbox")
ORGANISATION_END = r"\b(?:Co|Inc|Corp|Ltd)\.$"
SENTENCE_END = r"[.!?。！？;；]\s*$"
RIGHT_DATE = r"(?:(?:19|20)\d{2}(?:[./-]\d{1,2})?|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(?:19|20)\d{2}|present|current|now|至今|现在)"
LAYOUT_RISK = (
    r"multi.?column|possible\s+(?:multiple\s+)?columns?|(?:two|multiple)\s+columns|columns?\s+(?:layout|ambiguity|risk)|"
    r"reading[ -]?order\s+(?:is\s+)?(?:ambigu|uncertain|risk)|ambiguous\s+reading[ -]?order|多列|双栏|阅读顺序(?:有|存在)?(?:歧义|风险)|顺序歧义"
)

# Words that explain a contact on its line.
MAIL_LABELS = ["email", "e-mail", "mail", "邮箱", "电子邮箱", "电子邮件"]
LINK_LABELS = ["portfolio", "website", "web", "site", "homepage", "linkedin", "github", "主页", "个人网站", "作品集", "领英"]
PHONE_LABELS = ["phone", "tel", "telephone", "mobile", "电话", "手机"]

# Placeholders that bar final output.
PLACEHOLDER = r"【\s*(?:待确认|待补充|待填写|待填)[^】]*】|\[TODO[^\]]*\]|\b(?:TODO|TBD|YYYY)\b"

# Coaching patterns and clues.
NUMBER = r"\d+(?:\.\d+)?\s*(?:%|％|家|人|次|倍|hours?|days?|users?|clients?)|提升|增长|降低|improv|increas|reduc"
OWNERSHIP = r"主导|独立|全面负责|led\b|lead\b|owned\b|solely"
VAGUE = r"负责|参与|协助|responsible|participat|assist|help"
NEGATIVE = r"不(?:会|懂|熟悉|擅长|负责)|没有|未(?:使用|掌握|负责)|无经验|\b(?:no|not|never|without|lack|cannot|can.t)\b"
CLAUSE = r"[。；;\n]"
ROLE_CLUES = {
    "software": r"开发|实现|测试|调试|deploy|implement|debug|built|API|Swift|Python|JavaScript",
    "data": r"数据|分析|报表|SQL|Excel|dataset|analysis|analy[sz]|report|dashboard",
    "product": r"用户|需求|反馈|优先级|产品|user|requirement|feedback|prioriti|product",
    "design": r"设计|交互|原型|可用性|design|prototype|usability|Figma",
    "marketing": r"活动|渠道|内容|投放|增长|campaign|channel|content|growth|marketing",
    "sales": r"客户|续费|负责销售|销售拓展|销售谈判|销售支持|签约|client|customer|renewal|sold\b|sales\s+(?:support|cycle|negotiation|pipeline)|contract",
    "finance": r"财务|审计|账目|会计|finance|audit|accounting|ledger",
    "operations": r"流程|协调|交付|模板|协作|process|coordinat|deliver|template|workflow",
}
SOURCE_DOUBT = r"OCR|partial|failed|missing|ambigu|possible columns|多列|未提取|顺序歧义"

# Line ends of a text, as Python's splitlines has them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# Roles - Chinese and English label, sections in order, pattern of a bullet.
ROLE_TEMPLATES = {
    "software": ("软件工程", "Software Engineer", ["summary", "skills", "experience", "projects", "education"], "针对【约束】，实现【组件/方案】，以【验证方式】确认【结果】。"),
    "data": ("数据与算法", "Data / ML Specialist", ["summary", "skills", "experience", "projects", "education"], "在【数据范围】上采用【方法】，相对【基线】得到【结果及验证范围】。"),
    "product": ("产品经理", "Product Manager", ["summary", "experience", "projects", "skills", "education"], "针对【用户问题】，推动【取舍/功能】，通过【实验或反馈】验证【结果】。"),
    "design": ("设计", "Product / UX Designer", ["summary", "projects", "experience", "skills", "education"], "根据【研究发现】调整【设计】，通过【验证方法】确认【结果】，作品见【链接】。"),
    "marketing": ("市场与运营", "Marketing / Growth Specialist", ["summary", "experience", "projects", "skills", "education"], "面向【人群】执行【渠道策略】，在【周期/投入】下取得【可归因结果】。"),
    "sales": ("销售与客户成功", "Sales / Customer Success", ["summary", "experience", "projects", "skills", "education"], "负责【客户范围】的【销售/续费环节】，通过【动作】实现【已确认业务结果】。"),
    "finance": ("财务与审计", "Finance / Accounting", ["summary", "certifications", "experience", "skills", "education"], "针对【财务/控制范围】执行【分析或流程】，形成【已验证交付/改进】。"),
    "operations": ("项目与职能运营", "Operations / Project Specialist", ["summary", "experience", "projects", "skills", "education"], "协调【范围】并改进【流程】，按【验收标准】交付【结果】。"),
    "graduate": ("应届与实习", "Graduate / Intern", ["education", "projects", "experience", "skills"], "在【课程/实习/志愿项目】中负责【行动】，交付【作品或验证结果】。"),
    "career-change": ("转行", "Career Transition", ["summary", "projects", "skills", "experience", "education"], "将【已有能力】用于【目标领域真实项目】，完成【行动和成果】。"),
}

# Rubric dimensions and their weights; the one that needs a rendered document.
RUBRIC = {"目标匹配": 25, "证据与可信度": 25, "成果与价值": 20, "结构与取舍": 10, "表达质量": 10, "排版与提取": 10}
LAYOUT_DIMENSION = "排版与提取"
