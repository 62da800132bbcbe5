"""Era of a text by its words: modern, ancient or mixed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, once, strip


@dataclass(frozen=True)
class Vocabulary:
    modern: tuple[str, ...]
    modern_common: tuple[str, ...]
    ancient: tuple[str, ...]
    ancient_common: tuple[str, ...]


# Words of each era.
MODERN = (
    "电脑 手机 互联网 微信 抖音 微博 小程序 APP App iPhone Android 地铁 高铁 飞机 汽车 公交车 共享单车 电动汽车 自动驾驶 改革开放 21世纪 20世纪 19世纪 台风 雾霾 全球变暖 碳排放 碳中和 大数据 "
    "人工智能 AI 算法 区块链 元宇宙 数字经济 社区服务中心 物业 医保 社保 养老金 公积金 超市 便利店 网约车 外卖 快递 电商 电影 电视剧 综艺 直播 网红 KOL 博主 志愿者 居委会 村委会 公务员 上班族 新冠 疫情 疫苗 "
    "核酸检测 健康码 行程码 隔离 封控 电子支付 支付宝 微信支付 扫码 知乎 B站 小红书 公众号 Instagram YouTube Twitter Facebook 健身 瑜伽 马拉松 健身教练 空调 冰箱 洗衣机 微波炉 电磁炉 电视机 投影仪 "
    "请假 辞职 跳槽 KPI OKR 996 内卷 躺平 摆烂 职场 新能源 光伏 5G 芯片 智能手机 笔记本电脑 平板 耳机 蓝牙 金融 股票 基金 理财 贷款 信用卡 房贷 首付 教育 双减 考研 考公 高考 留学 课外班 网购 电商购物 网上购物"
)
MODERN_COMMON = (
    "现代 当代 如今 现在 今天 今年 本月 近日 近期 公里 小时 分钟 百分比 数据 报告 调查 居民 市民 业主 客户 用户 群众 保险 贷款 银行 利率 汇率 投资 网络 信号 直播 视频 照片 图片 内容 民主 宪政 法案 组织 委员会 联合国 WTO 研究 论文 科研 大学 学院"
)
ANCIENT = (
    "清政府 清朝 大清 满清 清代 清廷 清军 晚清 清末 明代 明朝 明军 明廷 大汉 汉代 汉朝 汉军 西汉 东汉 大唐 唐代 唐朝 唐军 盛唐 大宋 宋代 宋朝 宋军 北宋 南宋 大秦 秦代 秦朝 秦军 三国 魏蜀吴 三国鼎立 三国演义 大元 元代 元朝 大隋 "
    "隋代 隋朝 大晋 晋朝 晋代 南北朝 北魏 先秦 春秋战国 夏朝 商朝 周朝 民国 北洋 军阀 辽代 金代 西夏 五代十国 皇帝 陛下 朕 寡人 奴才 跪 叩首 奏折 圣旨 诏书 太后 王爷 皇子 太子 公主 驸马 丞相 尚书 太监 宦官 锦衣卫 东厂 禁军 "
    "御林军 八旗 绿营 科举 进士 状元 秀才 举人 老爷 县官 知府 知州 道台 巡抚 总督 提督 总兵 参将 宰相 首辅 大臣 百官 秦始皇 嬴政 刘邦 项羽 汉武帝 曹操 刘备 孙权 诸葛亮 关羽 李世民 唐太宗 武则天 李白 杜甫 赵匡胤 王安石 苏轼 "
    "岳飞 朱元璋 张居正 王阳明 郑和 康熙 乾隆 雍正 慈禧 曾国藩 李鸿章 孙中山 蒋介石 成吉思汗 忽必烈 甲午 鸦片战争 赤壁之战 官渡之战 安史之乱 靖康 辛亥革命 五四运动 青铜 竹简 帛书 车马 战车 旌旗 匈奴 突厥 契丹 女真 鞑靼 汉服 "
    "唐装 马褂 长袍 马靴 顶戴 马蹄袖 铠甲 战袍 牛车 马匹 驿站 烽火台 长城 朝贡 藩属 天朝 中原 塞外 西域 焚书坑儒 贞观之治 开元盛世 靖康之耻 昭君出塞 张骞出使 郑和下西洋 虎门销烟 戊戌变法 康有为 梁启超"
)
ANCIENT_COMMON = (
    "古代 历史 传统 古时 古 旧时 春秋 战国 汉代 唐代 宋代 明代 清代 史记 汉书 资治通鉴 江山 社稷 天下 黎民 苍生 君子 小人 贤 德 道 礼 甲胄 刀刃 弓箭 长矛 古筝 琵琶 箫 笛 琴 笔墨 纸砚 诗 词 赋 祭祀 礼乐 宗庙 祖先"
)
VOCABULARY = Vocabulary(*(tuple(words.split()) for words in (MODERN, MODERN_COMMON, ANCIENT, ANCIENT_COMMON)))


def detect(text: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """Struct of era, confidence and keywords (in the vocabulary's order). An exclusive word counts three."""
    strings = lambda words: F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")

    def hits(t: Column, words: tuple[str, ...]) -> Column:
        return F.filter(strings(words), lambda w: F.contains(t, w))

    def told(h: Column) -> Column:
        m, a = h["m"], h["a"]
        ms, as_ = F.size(m) * 3 + h["mc"], F.size(a) * 3 + h["ac"]
        sure = lambda s: F.least(F.lit(0.6) + s * 0.08, F.lit(0.98))
        none = F.array().cast("array<string>")
        era = lambda name, confidence, words: F.struct(F.lit(name).alias("era"), confidence.alias("confidence"), words.alias("keywords"))
        return (
            F.when(h["short"], era("mixed", F.lit(0.0), none))
            .when((ms >= 2) & (ms >= as_ * 1.5), era("modern", sure(ms), F.slice(m, 1, 5)))
            .when((F.size(m) >= 1) & (F.size(a) == 0), era("modern", F.lit(0.8), F.slice(m, 1, 3)))
            .when((as_ >= 2) & (as_ >= ms * 1.5), era("ancient", sure(as_), F.slice(a, 1, 5)))
            .when((F.size(a) >= 1) & (F.size(m) == 0), era("ancient", F.lit(0.8), F.slice(a, 1, 3)))
            .when((ms > as_) & (ms >= 2), era("modern", F.lit(0.6), F.slice(m, 1, 3)))
            .when((as_ > ms) & (as_ >= 2), era("ancient", F.lit(0.6), F.slice(a, 1, 3)))
            .otherwise(era("mixed", F.lit(0.0), none))
        )

    def scan(t: Column) -> Column:
        v = vocabulary
        return F.struct(
            hits(t, v.modern).alias("m"), hits(t, v.ancient).alias("a"), F.size(hits(t, v.modern_common)).alias("mc"), F.size(hits(t, v.ancient_common)).alias("ac"),
            (is_blank(t) | (F.length(t) < 3)).alias("short"))

    return once(strip(F.coalesce(text, F.lit(""))), lambda t: once(scan(t), told))


def add_era(scenes: Column, language: Column, vocabulary: Vocabulary = VOCABULARY) -> Column:
    """Scenes with era, era_confidence and era_keywords; only of documents in Chinese, null in others."""

    def one(s: Column) -> Column:
        found = once(detect(s["text"], vocabulary), lambda e: F.when(language == "zh", e))
        return once(F.struct(s.alias("s"), found.alias("e")), lambda x: x["s"].withField("era", x["e"]["era"]).withField("era_confidence", x["e"]["confidence"]).withField("era_keywords", x["e"]["keywords"]))

    return F.transform(scenes, one)
