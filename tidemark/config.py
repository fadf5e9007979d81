"""Values that define results. Every operator takes them as parameters and has these as defaults."""

from __future__ import annotations

# Word lists, thresholds, calendars and formats of the domain.
DEFAULT_KEYWORDS = (
    "earnings", "revenue", "profit", "loss", "guidance", "forecast", "acquisition", "merger", "dividend", "buyback",
    "layoff", "restructuring", "FDA", "approval", "patent", "lawsuit", "settlement", "investigation", "upgrade",
    "downgrade", "rating", "target", "analyst", "outlook", "inflation", "interest rate", "fed", "gdp", "unemployment", "jobs",
)
HIGH_IMPACT = ("earnings", "acquisition", "merger", "FDA approval", "bankruptcy", "investigation", "lawsuit", "guidance", "forecast", "rate decision")
MEDIUM_IMPACT = ("dividend", "buyback", "upgrade", "downgrade", "analyst", "partnership", "contract", "expansion")
RELIABLE_SOURCES = ("reuters", "bloomberg", "wsj", "cnbc", "sec", "nasdaq", "alpha vantage", "fred", "financial times")
POSITIVE = ("beat", "exceed", "strong", "growth", "upgrade", "buy", "positive", "profit", "gain", "success", "bullish")
NEGATIVE = ("miss", "decline", "weak", "loss", "downgrade", "sell", "negative", "cut", "fail", "bearish", "warning")
CATEGORIES = {
    "company_news": ("earnings", "revenue", "profit", "loss", "ceo", "announces", "partnership", "acquisition", "merger", "product", "launch", "lawsuit", "settlement"),
    "macro_event": ("fed", "interest rate", "inflation", "gdp", "unemployment", "jobs report", "consumer price", "trade", "tariff", "central bank"),
    "technical_data": ("price", "volume", "support", "resistance", "moving average", "breakout", "volatility"),
    "market_sentiment": ("sentiment", "bullish", "bearish", "fear", "greed", "trending", "social media", "reddit", "twitter", "analyst rating"),
}
TOPICS = {
    "FX": ("dollar", "yen", "euro", "currency", "forex", "fx", "exchange rate", "usd", "jpy", "eur", "gbp", "devaluation", "appreciation", "central bank intervention", "carry trade", "dxy"),
    "RATE": ("interest rate", "fed", "fomc", "basis points", "bps", "yield", "treasury", "bond", "rate cut", "rate hike", "policy rate", "real rate", "nominal rate", "dot plot"),
    "CREDIT": ("credit", "cds", "spread", "default", "high yield", "investment grade", "ig", "hy", "liquidity", "funding", "libor", "sofr", "basis", "swap spread"),
    "COMMODITY": ("oil", "crude", "gold", "copper", "commodity", "opec", "natural gas", "wti", "brent"),
    "EQUITY": ("stock", "equity", "s&p", "nasdaq", "dow", "market", "earnings", "valuation", "pe"),
    "Fiscal Policy": ("fiscal", "deficit", "debt ceiling", "spending", "tax", "stimulus", "infrastructure", "congress", "budget", "treasury issuance"),
    "Monetary Policy": ("monetary", "quantitative easing", "qe", "qt", "balance sheet", "inflation target", "ecb", "boj", "boe", "central bank", "hawkish", "dovish"),
    "Trump": ("trump", "tariff", "trade war", "china tariff", "immigration", "executive order"),
}
FINANCE_WORDS = (
    "stock", "market", "economy", "economic", "finance", "financial", "bank", "banking", "investment", "investor", "trading", "trade", "currency",
    "dollar", "yuan", "euro", "inflation", "deflation", "gdp", "unemployment", "employment", "jobs", "wage", "interest rate", "fed",
    "federal reserve", "central bank", "monetary policy", "fiscal policy", "budget", "debt", "deficit", "surplus", "recession", "growth", "earnings",
    "revenue", "profit", "loss", "quarterly", "annual", "forecast", "acquisition", "merger", "ipo", "dividend", "buyback", "layoff", "oil", "crude",
    "gold", "silver", "commodity", "commodities", "crypto", "bitcoin", "bond", "treasury", "yield", "spread", "index", "dow", "s&p", "nasdaq", "股票",
    "股市", "市场", "经济", "金融", "银行", "投资", "交易", "货币", "汇率", "通胀", "通缩", "GDP", "失业", "就业", "工资", "利率", "美联储", "央行", "货币政策", "财政政策", "预算", "债务", "赤字",
    "盈余", "衰退", "增长", "收益", "收入", "利润", "亏损", "季度", "年度", "预测", "收购", "合并", "IPO", "分红", "回购", "裁员", "石油", "原油", "黄金", "白银", "大宗商品", "加密货币", "比特币",
    "债券", "国债", "收益率", "利差", "指数", "道指", "标普", "纳斯达克", "A股", "港股", "美股", "人民币", "美元", "欧元", "日元", "英镑", "汇率", "贬值", "升值", "加息", "降息", "财报", "业绩",
    "业绩预告", "业绩快报", "年报", "季报", "中报", "一季报", "三季报", "涨停", "跌停", "涨停板", "跌停板", "牛市", "熊市", "震荡", "调整", "反弹", "回调", "板块", "行业", "概念", "题材", "热点", "龙头",
    "蓝筹", "成长股", "价值股", "基金", "私募", "公募", "券商", "保险", "信托", "期货", "期权", "ETF", "监管", "政策", "改革", "开放", "创新", "科技", "新能源", "人工智能", "AI", "消费", "零售",
    "房地产", "基建", "制造业", "服务业", "出口", "进口", "贸易",
)
MARKET_HOLIDAYS = (
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
)
SIGNAL_WEIGHTS = {"news_sentiment": 0.25, "technical": 0.30, "market_sentiment": 0.20, "sec_filings": 0.15, "macro": 0.10}
DIRECTION_AT = 0.15
DUPLICATE_AT = 0.85
T_ASSIGN, T_GRAPH = 0.68, 0.62
CHUNK_CHARS, CHUNK_OVERLAP = 2400, 288
FILING_WEIGHTS = (0.6, 0.3, 0.1)
BM25_K1, BM25_B = 1.2, 0.75
RRF_K = 60
ASK_WINDOW_SECONDS, ASK_WINDOW_MAX, ASK_DAILY_MAX = 60, 10, 3
MARKET_TZ = "America/New_York"
